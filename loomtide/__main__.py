import sys

from loomtide.cli import main

sys.exit(main())
