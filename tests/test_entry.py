"""The entry module without the training-data part, or without what that part needs."""

import subprocess
import sys
from pathlib import Path

import pytest

HOME = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("missing", ["corpus_pipeline", "tabloom.llm", "public_tokenizers"])
def test_base_survives(missing):
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; q = e.queries(); assert 'agg_all' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=HOME, check=True)
