import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

LONG = " ".join(f"wort{i % 977}" for i in range(60_000))

#: Texts that every operator must take: nothing, blanks, ties, repeats, other scripts, odd bytes, one very long text.
ODD_TEXTS = [
    None, "", " \t\n\x0b\x0c\r ", "one", "one", "ünï çødé 漢字 🙂 text", "a\x00b \x85   c d", "\n\n\nline\n\nline\n", "x" * 5000,
    "1" * 5000, LONG, LONG, "+1.2.3.4@ a@b @@ --", "<|endoftext|> 'll   ",
]


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Odd texts with NULL and repeated ids, and columns whose names clash with those of the operators."""
    rows = [(i if i != 3 else None, t, None, "s", None, i, f"r{i}", "w") for i, t in enumerate(ODD_TEXTS)]
    rows.append(rows[4])
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp bigint, row string, n_words string"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def empty_documents(odd_documents):
    return odd_documents.limit(0)
