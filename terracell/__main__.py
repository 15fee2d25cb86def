import sys

from terracell.cli import main

sys.exit(main())
