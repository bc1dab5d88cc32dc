from __future__ import annotations

from pyspark.sql import functions as F

from emberline.llm import licenses, queries


def test_against_sql(agrees):
    agrees(queries.op4_licenses, queries.ORACLES["op4_licenses"], "sf0.001")
    agrees(queries.op4_licenses, queries.ORACLES["op4_licenses"], "sf0.01")


def test_odd_rows(odd):
    got = {r["doc_id"]: r for r in licenses.scan(odd).where("doc_id is not null").collect()}
    assert (got[1]["n_words"], got[2]["n_words"], got[3]["n_words"]) == (0, 0, 0)
    assert got[6]["n_words"] == 30_000 and got[7]["n_words"] == 3
    assert all((r["n_base"], r["first_word"], r["base_labels"], r["labels"], r["score"]) == (0, None, "", "", 0.0) for r in got.values())
    assert licenses.scan(odd).count() == 10
    assert licenses.scan(odd.where(F.lit(False))).count() == 0


def test_places_and_labels(docs):
    filler = "lorem " * 1000
    rows = docs(
        (1, "CC  by-4.0, cc By; All Rights\nRESERVED"),
        (2, filler + "Released UNDER the MIT License." + filler),
        (3, "occ by all rightsreserved General Public Licenses"),
        (4, "general public license"),
        (5, "Licensed under CC BY-NC 4.0."),
        (6, "released under the mit"),
    )
    got = {r["doc_id"]: r for r in licenses.scan(rows).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (3, 0, 6, "cc-by,reserved")
    assert (got[2]["n_base"], got[2]["labels"], got[2]["score"]) == (0, "mit", 1.0)
    assert (got[3]["n_base"], got[3]["labels"]) == (0, "")
    assert (got[4]["base_labels"], got[4]["labels"]) == ("gpl", "gpl")
    assert (got[5]["base_labels"], got[5]["labels"]) == ("cc-by", "cc-by,cc-by-nc")
    assert got[6]["labels"] == ""


def test_the_join_finds_all_blocks(docs):
    """Filters lose nothing: all blocks against all templates."""
    templates = {"a b c d e f g h i j": "ten", "a b c d e": "five", "x y": "two"}
    texts = [(i, " ".join("abcdefghijxy"[(i * k + j) % 12] for j, k in enumerate(range(1, 40)))) for i in range(60)]
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(docs(*texts), templates=templates, phrases={"q q": "q"}, containment=0.8).collect()}
    for i, text in texts:
        words = text.split()
        blocks = [set(words[s : s + 64]) for s in range(0, len(words), 32)]
        want = {label for t, label in templates.items() for b in blocks if 10 * len(set(t.split()) & b) >= 8 * len(set(t.split()))}
        assert got[i] == ",".join(sorted(want))


def test_whole_texts_at_any_place(docs):
    """A template of any length is found wherever it begins, exactly and with a few words changed."""
    long = " ".join(f"t{i}" for i in range(50))
    whole = next(t for t, label in licenses.TEMPLATES.items() if label == "mit-text")
    changed = whole.split()
    for i in (3, 77, 120):
        changed[i] = "changed"
    rows = [(i, f"{'x ' * i}{long} {'y ' * 40}") for i in range(0, 70, 7)]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan(docs(*rows), templates={long: "long"}).collect()}
    assert set(got.values()) == {("long", 1.0)}
    rows = [(i, f"{'filler ' * (i * 37)}{t.upper()}. {'y ' * 300}") for i, t in enumerate([whole, " ".join(changed)] * 4)]
    got = licenses.scan(docs(*rows)).collect()
    assert all("mit-text" in r["labels"].split(",") for r in got)
    half = docs((1, " ".join(whole.split()[:80])))
    assert "mit-text" not in licenses.scan(half).first()["labels"]


def test_without_phrases_or_templates(docs):
    rows = docs((1, "all rights reserved"), (2, None), (3, "released under the mit license"))
    got = {r["doc_id"]: (r["n_base"], r["base_labels"], r["labels"]) for r in licenses.scan(rows, phrases={}).collect()}
    assert got == {1: (0, "", "reserved"), 2: (0, "", ""), 3: (0, "", "mit")}
    got = {r["doc_id"]: (r["n_base"], r["labels"], r["score"]) for r in licenses.scan(rows, templates={}).collect()}
    assert got == {1: (1, "reserved", 1.0), 2: (0, "", 0.0), 3: (0, "", 0.0)}
