import sys

from siftwell.plans.cli import main

sys.exit(main())
