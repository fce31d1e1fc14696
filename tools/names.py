"""Names of the queries registered by a module of ``contract``."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from contract import REGISTRY  # noqa: E402

print(*[n for n, (fn, _) in REGISTRY.items() if fn.__module__.split(".")[-1] in sys.argv[1:]])
