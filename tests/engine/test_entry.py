import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parents[2]


def imported(*gone: str) -> subprocess.CompletedProcess:
    """The driver entry imported where the modules ``gone`` do not exist."""
    hide = "".join(f"sys.modules[{name!r}] = None; " for name in gone)
    code = f"import sys; {hide}import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"
    return subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=300)


def test_entry_works_without_the_training_data_operators():
    for gone in (["corpus_pipeline"], ["siftwell.llm"], ["corpus_pipeline", "siftwell.llm"]):
        done = imported(*gone)
        assert done.returncode == 0 and done.stdout.split()[1] == "False", done.stderr
