"""Benchmark passages cut out of documents that stay."""

import random

from rasterloom.llm import winnow


def test_no_passage_stays(spark):
    rng = random.Random(11)
    fill = lambda n: " ".join(f"w{rng.randint(0, 9999)}" for _ in range(n))
    one, two = fill(13), fill(30)
    words = two.split()
    # Cutting ``one`` out of the third text puts the halves of ``two`` side by side.
    texts = [fill(900), f"Élan, {fill(600)} {one.upper()}. {fill(600)} ende", f"{fill(900)} {' '.join(words[:12])} {one} {' '.join(words[12:24])} {fill(900)}", f"{fill(50)} {two}", None, ""]
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, n_chars int")
    benchmark = spark.createDataFrame([("a", one), ("b", two)], "item_id string, text string")
    kept = winnow.clean_documents(docs, benchmark)
    got = {r.doc_id: r for r in kept.collect()}
    assert sorted(got) == [0, 1, 2, 4, 5] and kept.schema == docs.schema
    found, name = winnow.with_hits(kept, benchmark)
    assert not [r for r in found.collect() if r[name].spans]
    assert got[0].text == texts[0] and got[4].text is None
    assert got[1].text == texts[1].replace(one.upper(), "") and got[1].n_chars == len(got[1].text)
    assert got[2].text.split() == texts[2].split()[:900] + texts[2].split()[-900:]
