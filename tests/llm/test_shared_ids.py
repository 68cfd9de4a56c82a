"""Rows without an id of their own."""

import hashlib
import random

from helixframe.llm import substring_dedup


def removed_alone(text):
    """What goes from a text by itself: bytes under a 100-byte string that stands earlier in it."""
    raw, seen, gone = text.encode(), set(), set()
    for p in range(len(raw) - 99):
        piece = raw[p : p + 100]
        if piece in seen:
            gone |= set(range(p, p + 100))
        seen.add(piece)
    spans = sum(b not in gone for b in (x - 1 for x in gone))
    return len(raw), len(gone), spans, hashlib.sha256(bytes(b for i, b in enumerate(raw) if i not in gone)).hexdigest()


def test_many_texts_without_an_id_are_told_apart(spark):
    """1,500 unlike texts of null id, so many that hashes of 16 bits would meet; a third of them repeat a passage of their own."""
    draw = random.Random(6)
    say = lambda n: " ".join("".join(draw.choices("abcdefgh", k=5)) for _ in range(n))
    texts = []
    for i in range(1500):
        body = say(25)
        texts.append(f"{body} {say(3)} {body}" if i % 3 == 0 else body + say(30))
    frame = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string").repartition(6)
    got = sorted(tuple(r)[1:] for r in substring_dedup.substring_removal(frame).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == sorted(removed_alone(t) for t in texts)
