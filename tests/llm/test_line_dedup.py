import random

import pytest
from helpers import make_docs, rows_of
from hypothesis import given
from hypothesis import strategies as st

from sherdline.llm import line_dedup


def plain(rows):
    """(doc_id, removed spans) with every digest held in one place."""
    tiles = [line_dedup.units(t or "") for _, t in rows]
    ids = [line_dedup.LAST if i is None else i for i, _ in rows]
    where: dict = {}
    for i, units in zip(ids, tiles):
        for *_, words, digest in units:
            if words:
                where.setdefault(digest, []).append(i)
    out = []
    for (doc_id, text), i, units in zip(rows, ids, tiles):
        seen, spans, run = set(), [], []
        for start, end, words, digest in [*units, (0, 0, 1, None)]:
            repeat = bool(words) and len(where.get(digest, ())) > 1 and (min(where[digest]) != i or digest in seen)
            seen.add(digest)
            if repeat or run and not words:
                run.append((start, end, words))
            else:
                if sum(w for *_, w in run) >= line_dedup.RUN_WORDS:
                    spans.append((run[0][0], run[-1][1]))
                run = []
        out.append((doc_id, ",".join(f"{a}:{b}" for a, b in spans)))
    return sorted(out, key=repr)


def test_documents_against_plain(documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    found = line_dedup.dedup_lines(documents)
    assert rows_of(found, "doc_id", "removed") == plain(rows)
    texts = dict(rows)
    for r in found.collect():
        spans = [tuple(map(int, s.split(":"))) for s in r.removed.split(",") if s]
        assert r.n_removed == len(spans) and line_dedup.without(texts[r.doc_id], spans) == r.text


def test_odd_documents(odd_docs, odd_rows):
    assert rows_of(line_dedup.dedup_lines(odd_docs), "doc_id", "removed") == plain(odd_rows)


def test_empty_table(no_docs):
    assert line_dedup.dedup_lines(no_docs).collect() == []
    assert line_dedup.cleaned(no_docs).collect() == []


def prose(rng, n, stops=True):
    return " ".join("".join(rng.choices(["ka", "lo", "mi", "ne", "pu", "ra"], k=rng.randint(4, 6))) + ("." if stops and rng.random() < 0.1 else "") for _ in range(n))


@pytest.mark.parametrize("stops", [True, False])
def test_passages_inside_lines_are_removed_from_all_but_the_first(spark, stops):
    rng = random.Random(8)
    passage = prose(rng, 60, stops)
    rows = [(i, prose(rng, 37, stops) + " " + passage + " " + prose(rng, 41, stops)) for i in range(1, 6)]
    clean = [(i, prose(rng, 120, stops)) for i in range(10, 20)]
    found = {r.doc_id: r for r in line_dedup.dedup_lines(make_docs(spark, rows + clean)).collect()}
    assert found[1].n_removed == 0 and all(found[i].n_removed == 0 for i, _ in clean)
    for i, text in rows[1:]:
        left = set(found[i].text.split())
        assert found[i].n_removed >= 1
        assert sum(w in left for w in passage.split()) <= 30  # the units at its two ends may stay
        assert len(text.split()) - len(found[i].text.split()) <= 62


def test_short_shared_lines_stay(spark):
    docs = make_docs(spark, [(i, f"Own words of number {i} stand here.\nAll rights reserved by the same people.") for i in range(5)])
    assert all(r.n_removed == 0 for r in line_dedup.dedup_lines(docs).collect())


def test_cleaned_returns_the_columns(spark):
    text = " ".join(f"w{i}" for i in range(80))
    docs = make_docs(spark, [(1, text), (2, text), (3, None)])
    out = line_dedup.cleaned(docs)
    assert out.schema == docs.schema
    assert rows_of(out, "doc_id", "text", "n_chars") == sorted([(1, text, len(text)), (2, "", 0), (3, None, None)], key=repr)


def test_cleaned_with_columns_of_the_same_names(spark):
    text = " ".join(f"w{i}" for i in range(80))
    docs = make_docs(spark, [(1, text), (2, text)])
    docs = docs.withColumn("__id", docs["fp"]).withColumn("__BODY", docs["fp"]).withColumn("__repeats", docs["n_chars"]).withColumn("__of_id", docs["n_chars"])
    out = line_dedup.cleaned(docs)
    assert out.schema == docs.schema
    assert rows_of(out, "doc_id", "text", "__id", "__repeats") == [(1, text, "x", len(text)), (2, "", "x", len(text))]


@given(st.text(alphabet="ab .!?\n\t\r'\")é ", max_size=200))
def test_units_tile_the_text(text):
    units = line_dedup.units(text)
    assert "".join(text[a:b] for a, b, *_ in units) == text
    assert sum(w for *_, w, _ in units) == len(text.encode().split())
