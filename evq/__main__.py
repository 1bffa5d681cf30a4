"""python -m evq"""

import sys

from evq.cli import main

sys.exit(main())
