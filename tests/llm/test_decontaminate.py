"""Contaminations against windows compared without masks."""

from itertools import combinations
from math import ceil

import pytest

from folio.llm import decontaminate

from .conftest import prose


@pytest.mark.parametrize("length", range(1, 14))
def test_every_tolerated_pattern_has_a_hit(length):
    masks = decontaminate.covering(decontaminate.MASKS, length, 0.8)
    for gone in combinations(range(length), length - ceil(length * 0.8)):
        assert any(not set(gone) & set(at) for m in masks for at in decontaminate._hit(m, length)), gone


def contaminated_model(docs, items):
    out = set()
    for d, text in docs:
        doc = text.split()
        for i, passage in items:
            item = passage.split()
            compared = min(13, len(item))
            for shift in range(-len(item), len(doc)):
                same = [0 <= k + shift < len(doc) and doc[k + shift] == w for k, w in enumerate(item)]
                if any(sum(same[s:s + compared]) >= ceil(compared * 0.8) for s in range(len(item) - compared + 1)):
                    out.add((d, i))
                    break
    return out


def test_tolerated_substitutions_are_found_in_items_of_any_length(spark):
    items, docs = [], []
    for n in (1, 3, 5, 7, 8, 10, 13, 15):
        words = [f"i{n}w{k}" for k in range(n)]
        items.append((n, " ".join(words)))
        most = min(13, n) - ceil(min(13, n) * 0.8)
        for differ in {0, most, most + 1}:
            for gone in list(combinations(range(n), differ))[:120]:
                passage = " ".join("other" if k in gone else w for k, w in enumerate(words))
                docs.append((len(docs), f"{prose(len(docs), 3)} {passage} {prose(len(docs) + 7000, 3)}"))
    found = decontaminate.contaminations(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == contaminated_model(docs, items)


def test_items_without_an_id_are_reported(spark):
    bench = spark.createDataFrame([(None, prose(900, 30)), (None, prose(901, 20)), (1, prose(900, 30))], "item_id long, text string")
    docs = spark.createDataFrame([(1, prose(1, 9) + " " + prose(900, 30)), (2, prose(901, 20)), (3, prose(3, 50))], "doc_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminations(docs, bench).collect()}
    assert found == {(1, None), (1, 1), (2, None)}
    assert [r.doc_id for r in decontaminate.clean_documents(docs, bench).collect()] == [3]
