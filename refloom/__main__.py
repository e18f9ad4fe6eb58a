"""python -m refloom."""

import sys

from refloom.cli import main

sys.exit(main())
