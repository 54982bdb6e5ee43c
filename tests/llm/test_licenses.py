import random
import re

import duckdb
import pytest
from helpers import SMALL, make_docs, rows_of

from sherdline.llm import licenses


def plain(rows, templates, contained=licenses.CONTAINED):
    cut = lambda t: [w for w in re.split(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").lower()) if w]
    runs = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    out = set()
    for doc_id, text in rows:
        words = cut(text)
        for name, template in templates.items():
            n = min(licenses.SHINGLE, len(cut(template)))
            want = runs(cut(template), n)
            got = len(want & runs(words, n))
            if want and got / len(want) >= contained:
                out.add((doc_id, name, got, text))
    return sorted((row[:3] for row in out), key=repr)


def test_documents_against_sql(documents):
    duckdb.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM read_parquet('{SMALL}/documents.parquet')")
    expected = sorted(duckdb.execute(licenses.oracle()).fetchall(), key=repr)
    assert expected and rows_of(licenses.scan(documents), "doc_id", "license", "n_found", "containment") == expected


def test_odd_documents(odd_docs, odd_rows, no_docs):
    assert rows_of(licenses.scan(odd_docs), "doc_id", "license", "n_found") == plain(odd_rows, licenses.NOTICES)
    assert licenses.scan(no_docs).collect() == []


@pytest.mark.parametrize("edits", [0, 1, 2])
def test_notices_inside_prose(spark, edits):
    """Notices at every place of a text, some words of the long ones changed."""
    rng = random.Random(edits)
    prose = lambda n: " ".join(f"w{rng.randint(0, 9999)}" for _ in range(n))
    rows = [(None, None), (100, "")]
    for i, (name, text) in enumerate(licenses.NOTICES.items()):
        for lead in range(9):
            words = text.split()
            for _ in range(edits if len(words) > 40 else 0):
                words[rng.randrange(len(words))] = "changed"
            rows.append((i, prose(lead) + "\n" + " ".join(words).upper() + " -- " + prose(rng.randint(0, 40))))
    expected = plain(rows, licenses.NOTICES)
    assert rows_of(licenses.scan(make_docs(spark, rows)), "doc_id", "license", "n_found") == expected
    assert len({name for _, name, _ in expected}) == len(licenses.NOTICES) or edits


def test_templates_of_any_length(spark):
    templates = {f"t{n}": " ".join(f"t{n}x{i}" for i in range(n)) for n in (1, 2, 4, 5, 6, 8, 9, 11, 12, 13, 40)}
    rows = [(n, f"lead in here {text} and out") for n, (name, text) in enumerate(templates.items())]
    table = spark.createDataFrame([*templates.items(), ("empty", ""), ("null", None)], "license string, text string")
    assert rows_of(licenses.scan(make_docs(spark, rows), table), "doc_id", "license", "n_found") == plain(rows, templates)


def test_the_plan_has_no_python(documents):
    plan = licenses.scan(documents)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|ExistingRDD", plan)
