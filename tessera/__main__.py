"""``python -m tessera``."""

import sys

from tessera.cli import main

if __name__ == "__main__":
    sys.exit(main())
