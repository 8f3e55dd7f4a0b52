import sys

from fathomark.cli import main

sys.exit(main())
