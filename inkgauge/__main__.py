import sys

from inkgauge.cli import main

sys.exit(main())
