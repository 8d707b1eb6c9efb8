"""The driver's entry, with and without what the corpus operators need."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

HIDDEN = """
import sys, warnings
warnings.simplefilter("ignore")
class Hide:
    def find_spec(self, name, path=None, target=None):
        if name in {hidden!r}:
            raise ImportError(name)
sys.meta_path.insert(0, Hide())
sys.path.insert(0, {root!r})
import __spark_entry__ as e
print(len(e.queries()), len(e.oracle_sql()), any(n.startswith("op") for n in e.queries()), "pipeline" in e.queries())
"""


def names(*hidden):
    code = HIDDEN.format(hidden=hidden, root=str(ROOT))
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    n, m, ops, pipeline = out.stdout.split()[-4:]
    return int(n), int(m), ops == "True", pipeline == "True"


def test_without_the_tokenizers_the_analysis_stays():
    n, m, ops, pipeline = names("public_tokenizers")
    assert n == m >= 70 and not ops and not pipeline


def test_without_the_subpackage_the_analysis_stays():
    assert names("ripplefront.llm.queries", "corpus_pipeline")[2:] == (False, False)


def test_public_names():
    import ripplefront

    assert all(getattr(ripplefront, name) is not None for name in ripplefront.__all__)
    assert "trace" in dir(ripplefront)
