import sys

from quizlens.cli import main

sys.exit(main())
