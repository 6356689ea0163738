import sys

from loomspark.cli import main

sys.exit(main())
