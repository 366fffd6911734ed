import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
