import sys

from quillspark.cli import main

sys.exit(main())
