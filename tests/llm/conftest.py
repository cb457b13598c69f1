import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from conftest_llm import messy, messy_rows, nothing, words  # noqa: E402, F401
