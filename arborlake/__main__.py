import sys

from arborlake.cli import main

sys.exit(main())
