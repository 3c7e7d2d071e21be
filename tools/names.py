"""Names of the queries of one part: python tools/names.py matching"""

import importlib
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from bindings import registry  # noqa: E402

importlib.import_module(f"bindings.{sys.argv[1]}")
print(" ".join(registry.QUERIES))
