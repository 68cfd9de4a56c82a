"""Ranked search, source divergence and personal data against brute force, and their awkward rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import lexical_search as search
from helixframe.llm import personal_data as personal
from helixframe.llm import source_divergence as audit
from helixframe.llm.kernel import chunks
from helixframe.llm.terms import byte_class, chunk_terms

DOCS = "doc_id long, text string, lang string, source string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words_of(draw, n, many):
    return " ".join(draw.choice(["alpha", "Beta", "gämma", "δέλτα", "x1", "7"] + [f"w{i}" for i in range(many)]) for _ in range(n))


def test_terms_are_told_apart_where_hashes_meet(monkeypatch):
    from helixframe.llm import terms

    monkeypatch.setattr(terms, "mixed", lambda x, real=terms.mixed, seen=[]: seen.append(1) or (x * np.uint64(0) if len(seen) == 1 else real(x)))
    import pyarrow as pa

    chunk = next(chunks(pa.array(["One two ONE", None, "", "tWo three-öne"])))
    found, place, bounds = chunk_terms(chunk, byte_class((0x41, 0x5A), (0x61, 0x7A)))
    assert [found[int(p)].as_py() for p in place] == ["one", "two", "one", "two", "three", "öne"] and bounds.tolist() == [0, 3, 3, 3, 6]


# --- ranked search


def ranked(docs, items, top):
    """The contract, term by term."""
    of = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t))
    bags = [(i, Counter(of(t))) for i, t in docs]
    sizes = [sum(b.values()) for _, b in bags]
    n_docs, n_terms = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for (i, bag), n in zip(bags, sizes):
            m = 50 + (50 * n * n_docs) // max(n_terms, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 20 * m)) for t in set(of(text)) if bag[t])
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, rank + 1, None if null else i, -s) for rank, (s, null, i) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


def found_by(spark, docs, items, top):
    index = search.build_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))
    got = search.search(index, spark.createDataFrame(items, "item_id long, text string"), "item_id", top=top)
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.mark.parametrize(("seed", "block", "shard"), [(0, 128, 1 << 21), (1, 3, 200), (2, 8, 60)])
def test_search_equals_brute_force(spark, monkeypatch, seed, block, shard):
    """Small blocks and shards, so that items meet many blocks, skip some, and bests of many shards are merged."""
    monkeypatch.setattr(search, "BLOCK", block)
    monkeypatch.setattr(search, "SHARD_TOKENS", shard)
    monkeypatch.setattr(search, "FIRST_WAVE", 3)
    monkeypatch.setattr(search, "BATCH_ITEMS", 4)
    draw = random.Random(seed)
    docs = [(i, words_of(draw, draw.choice([0, 1, 5, 40]), draw.choice([3, 200]))) for i in range(300)]
    docs += [(1000 + i, docs[7][1]) for i in range(30)] + [(5, "again alpha"), (None, "alpha alpha x1"), (None, None), (400, None)]
    items = [(i, words_of(draw, draw.choice([1, 4, 30]), 200)) for i in range(12)] + [(50, None), (51, "?!"), (52, "unheard"), (0, "another text of item 0 alpha")]
    assert found_by(spark, docs, items, 10) == ranked(docs, items, 10)


def test_search_of_long_texts_and_empty_tables(spark):
    docs = [(1, "needle " + "hay " * 700_000), (2, "needle hay"), (3, "hay")]
    assert found_by(spark, docs, [(1, "Needle")], 50) == ranked(docs, [(1, "Needle")], 50)
    assert found_by(spark, [], [(1, "needle")], 5) == [] == found_by(spark, [(1, "needle")], [], 5)
    assert found_by(spark, [(1, None)], [(1, "needle")], 5) == []


def test_blocks_come_back_as_packed(monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 16)
    draw = np.random.default_rng(3)
    lists = [np.sort(draw.choice(5000, n, replace=False)) for n in (1, 15, 16, 17, 700)]
    term, doc = np.repeat(np.arange(5), [len(x) for x in lists]), np.concatenate(lists)
    tf, m = draw.integers(1, 300, len(doc)), draw.integers(50, 90, 5000)
    df, heads, payloads = search.posting_rows(term, doc, tf, m, 5)
    assert df.tolist() == [len(x) for x in lists]
    for t in range(5):
        postings = search.Postings(heads[t].as_py(), payloads[t].as_py(), m)
        read = [postings.block(b) for b in range(len(postings.head))]
        assert np.concatenate([d for d, _ in read]).tolist() == lists[t].tolist()
        assert np.concatenate([i for _, i in read]).tolist() == search.impacts(tf[term == t], m[lists[t]]).tolist()
        assert postings.most.tolist() == [int(i.max()) for _, i in read]


def test_blocks_below_the_threshold_stay_packed():
    """One list of a common term and one of a rare one: where the rare one is absent, nothing reaches the threshold."""
    n = 128 * 64
    m = np.full(n, 100)
    rare = np.arange(0, 60, 1)
    term = np.concatenate([np.zeros(n, int), np.ones(60, int)])
    _, heads, payloads = search.posting_rows(term, np.concatenate([np.arange(n), rare]), np.ones(n + 60, int), m, 2)
    lists = [(search.Postings(heads[t].as_py(), payloads[t].as_py(), m), w) for t, w in ((0, 10), (1, 5000))]
    docs, scores = search.best(lists, n, 50, 0)
    assert docs.tolist() == list(range(50)) and len(set(scores.tolist())) == 1
    assert len(lists[0][0].read) <= 16 < 64 == len(lists[0][0].head)  # the first step's intervals, no more


# --- source divergence


def audited(docs, least, top=10):
    """The contract over whole matrices of Python integers."""
    bags = [(lang or "", source or "", Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(t)))) for _, t, lang, source in docs]
    out = []
    for lang in {b[0] for b in bags}:
        mine = [b for b in bags if b[0] == lang]
        kept = sorted(t for t, n in Counter(t for b in mine for t in b[2]).items() if n >= least)
        groups = {s: Counter() for _, s, _ in mine}
        for _, s, bag in mine:
            groups[s].update({t: bag[t] for t in kept if bag[t]})
        whole = sum(groups.values(), Counter())
        part = lambda bag: {t: 1 + 1_000_000_000 * (bag[t] + 2) // (sum(bag.values()) + 2 * len(kept)) for t in kept}
        p, q = {s: part(bag) for s, bag in groups.items()}, part(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in groups:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in groups if o != s)
            out += [(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(pairs)]
            terms = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if groups[s][t] and p[s][t] > q[t])
            out += [(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(terms[:top])]
    return sorted(out)


@pytest.mark.parametrize(("seed", "lane", "seat"), [(0, 1 << 15, 8), (1, 7, 1), (2, 16, 2), (3, 1000, 3)])
def test_divergence_equals_brute_force(spark, monkeypatch, seed, lane, seat):
    """Lanes of few terms and seats of few groups: many rounds, odd and even numbers of seats, rests."""
    monkeypatch.setattr(audit, "ROUNDS", 2)
    draw = random.Random(seed)
    docs = []
    for i in range(250):
        lang = draw.choice(["en", "en", "de", None, "lone"])
        source = "only" if lang == "lone" else draw.choice(["hot"] * 6 + [f"s{k}" for k in range(9)] + ["", None])
        docs.append((i, words_of(draw, draw.choice([0, 3, 30]), 12 if source == "hot" else 40), lang, source))
    docs += [(900, None, "en", "empty"), (901, "1 2 3", "de", "digits"), (902, "rare", "once", "a"), (902, "rare", "once", "b"), (902, "rare", "once", "b")]
    got = audit.divergences(spark.createDataFrame(docs, DOCS).repartition(4).withColumn("lane", F.lit(1)), least=5, lane=lane, seat=seat)
    assert sorted(tuple(r) for r in got.collect()) == audited(docs, 5)


def test_divergence_of_nothing_and_of_long_texts(spark):
    assert audit.divergences(spark.createDataFrame([], DOCS)).collect() == []
    docs = [(i, "ein wort " * (300_000 if i == 3 else 3) + f"wort{'abc'[i % 3]}", "de", "ab"[i % 2]) for i in range(24)]
    assert sorted(tuple(r) for r in audit.divergences(spark.createDataFrame(docs, DOCS)).collect()) == audited(docs, 10)


def test_every_seat_meets_every_other_once(spark):
    for seats in range(1, 12):
        n = seats + seats % 2
        rows = spark.range(n - 1).selectExpr("id AS turn").crossJoin(spark.range(seats).selectExpr("id AS seat"))
        met = rows.select("turn", "seat", audit.schedule(F.col("turn"), F.col("seat"), F.lit(seats).cast("long")).alias("other")).collect()
        by = {(r.turn, r.seat): r.other for r in met}
        assert all(o >= seats or by[t, o] == s for (t, s), o in by.items())
        pairs = Counter(frozenset((s, o)) for (_, s), o in by.items() if o < seats)
        assert pairs == {frozenset((a, b)): 2 for a in range(seats) for b in range(a)}


def test_shares_are_exact_beyond_64_bits():
    counts, whole = np.array([0, 7, 10**15, 8 * 10**15]), 9 * 10**15
    assert audit.shares(counts, whole).tolist() == [1 + 10**9 * (int(c) + 2) // whole for c in counts]


# --- personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


def passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 10 <= len(digits) <= 15


def base_of(text):
    found = [(m.start(), rank, m.end(), kind) for rank, (kind, p) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if passes(kind, m.group())]
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found)]


def card(draw, n=16):
    body = "".join(draw.choice("0123456789") for _ in range(n - 1))
    return next(body + d for d in "0123456789" if luhn(body + d))


def awkward(draw):
    pieces = [
        "a@b.cx@d.e", "a@b.c_d@e.f", "x@y", ".@-.-", "é@b.de", "a.b@c.d.e-f.", "1.2.3.4.5.6.7.8", "256.1.1.1", "000255.1.01.0", "0.0.0.0", "12.34.56", "1.2.3.4x",
        card(draw), card(draw, 14), card(draw, 19), card(draw, 20), " ".join([card(draw)[i : i + 4] for i in range(0, 16, 4)]), "4111-1111 1111-1111", "0000 0000 0000 00",
        "+1 (017) 555-7713", "+1 2", "++49 30 1234567.", "+123456789012345678", "+49 (0) 30-12 34 56 7 ()", "Tel:+4930123456", "plain", "ünï", "\n", "-", "--", "@", "+", "5",
    ]
    return "".join(draw.choice(pieces) + draw.choice(["", " ", ", ", "  "]) for _ in range(draw.randint(0, 14)))


def test_base_spans_equal_the_plain_expressions(spark):
    draw = random.Random(5)
    texts = [awkward(draw) for _ in range(600)] + [None, "", "7" * 30_000, "1 " * 30_000, "a@" + "b." * 30_000, "x" * 200_000 + "@", "1." * 50_000, "+" + "- " * 50_000, "9" + "." * 60_000, "9" * 30_000 + ":" * 9]
    frame = spark.createDataFrame([(i % 500, t, "kept") for i, t in enumerate(texts)], "doc_id long, text string, personal string")
    got = personal.with_personal_data(frame)
    assert got.columns == ["doc_id", "text", "personal", "personal_1"]
    for row in got.collect():
        spans = [f"{s.kind}:{s.start}:{s.end}" for s in row.personal_1]
        assert [s for s in spans if not s.startswith("context")] == base_of(row.text), row.text
        assert row.personal == "kept"


def bootstrap(texts, rounds, least):
    """The method in plain Python: mentions, patterns, trust, noisy or, round after round."""
    run = r"A-Za-z0-9@._%+()-"
    mention = re.compile(rf"(?<![{run}:])[0-9A-Fa-f]{{0,4}}(?::[0-9A-Fa-f]{{0,4}}){{2,7}}(?![{run}:])|[{run}]*[0-9@][{run}]*(?:\x20[0-9().-]+)*")
    shape = {
        "email": lambda v: re.fullmatch(r"[^@]+@[^@]+", v),
        "ip": lambda v: re.fullmatch(r"[0-9]+(\.[0-9]+){3,}|[0-9A-Fa-f]{0,4}(:[0-9A-Fa-f]{0,4}){2,7}", v),
        "card": lambda v: re.fullmatch("[0-9][0-9 -]*", v) and 12 <= len(re.sub("[^0-9]", "", v)) <= 19,
        "phone": lambda v: re.fullmatch(r"\+?[0-9(][0-9 ().-]*", v) and 7 <= len(re.sub("[^0-9]", "", v)) <= 15,
    }
    places, links = defaultdict(set), defaultdict(set)
    for text in set(texts):
        end = 0
        for m in mention.finditer(text):
            value = m.group().rstrip("@._%+()-: ")
            words = [re.sub("[0-9]", "0", w) for w in re.split(r"[\x20\x09-\x0D]+", lower(text[end : m.start()][-64:])) if w]
            end = m.end()
            if any(f(value) for f in shape.values()):
                places[value].add((text, m.start(), m.start() + len(value)))
                links[value] |= {" ".join(words[-k:]) for k in (1, 2) if len(words) >= k}
    known = {v: next((k for k in BASE if re.fullmatch(BASE[k], v) and passes(k, v)), None) for v in places}
    found = {}
    for _ in range(rounds):
        held = defaultdict(set)
        for v, patterns in links.items():
            for p in patterns:
                held[p].add(v)
        rules = {}
        for p, values in held.items():
            counts = Counter(known[v] for v in values if known[v])
            kind = max(BASE, key=lambda k: (counts[k], -list(BASE).index(k)))
            if counts[kind] >= least and counts[kind] / (sum(counts.values()) + 1) >= 0.8 and counts[kind] >= 0.5 * len(values):
                rules[p] = kind, counts[kind] / (sum(counts.values()) + 1)
        new = {}
        for v in places:
            if known[v] is None:
                scores = {k: 1 - math.exp(round(sum(math.log1p(-t) for p in links[v] for kk, t in [rules.get(p, (None, 0))] if kk == k), 9)) for k in BASE if shape[k](v)}
                best = max(scores, key=lambda k: (scores[k], -list(BASE).index(k)), default=None)
                if best and scores[best] >= 0.8:
                    new[v] = best
        if not new:
            break
        found |= new
        known |= new
    out = defaultdict(list)
    for v, kind in found.items():
        for text, a, b in places[v]:
            out[text].append(f"context_{kind}:{a}:{b}")
    return {t: sorted(s, key=lambda x: int(x.split(":")[1])) for t, s in out.items()}


def planted(draw):
    """Contexts that always stand before a kind, unseen forms in them, chains that need a second round, and noise."""
    phone = lambda: f"+1 ({draw.randint(100, 999)}) 555-{draw.randint(1000, 9999)}"
    bare = lambda: f"0{draw.randint(20, 99)} {draw.randint(100, 999)} {draw.randint(1000, 9999)}"
    mail = lambda: f"p{draw.randint(1, 9999)}@mail.example.org"
    texts = [f"you may call me at {phone()} today" for _ in range(12)] + [f"write to {mail()} now" for _ in range(8)]
    hidden = [bare() for _ in range(6)]
    texts += [f"please call me at {h} today" for h in hidden] + ["write to root@localhost now"]
    texts += [f"Büro Durchwahl {h} frei" for h in hidden[:5]] + [f"Büro Durchwahl {bare()} frei" for _ in range(2)]
    texts += [f"the number {x} was seen" for x in [phone() for _ in range(6)] + [card(draw) for _ in range(6)] + [bare() for _ in range(3)]]
    texts += [f"order no. {draw.randint(10**7, 10**9)} shipped" for _ in range(9)] + [f"again {h}, dropped" for h in hidden[:1]]
    return texts + texts[:4]


@pytest.mark.parametrize("rounds", [1, 3])
def test_contexts_find_what_the_seeds_do_not(spark, rounds):
    texts = planted(random.Random(11))
    got = personal.with_personal_data(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), rounds=rounds)
    added = {r.text: [f"{s.kind}:{s.start}:{s.end}" for s in r.personal if s.kind.startswith("context")] for r in got.collect()}
    want = bootstrap(texts, rounds, personal.LEAST_VALUES)
    assert {t: s for t, s in added.items() if s} == want
    assert any("Durchwahl" in t for t in want) and any("localhost" in t for t in want)
    later = [t for t in texts if "Durchwahl" in t and t in want]
    assert len(later) == (5 if rounds == 1 else 7)  # only the second round knows the numbers that make Durchwahl trusted
    assert not any("order no." in t or "the number" in t for t in want)


def test_personal_data_query(spark, tmp_path):
    draw = random.Random(2)
    texts = [awkward(draw) for _ in range(80)] + planted(draw) + [None, ""]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    want = bootstrap([t or "" for t in texts], personal.ROUNDS, personal.LEAST_VALUES)
    for row in personal.op12_personal_data(spark, str(tmp_path)).collect():
        base, text = base_of(texts[row.doc_id]), texts[row.doc_id] or ""
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(s.startswith(f"{k}:") for s in base) for k in BASE]
        assert row.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        key = lambda s: (int(s.split(":")[1]), [*BASE, *(f"context_{k}" for k in BASE)].index(s.split(":")[0]))
        assert row.spans == ",".join(sorted(base + want.get(text, []), key=key))


def test_personal_data_of_an_empty_table(spark):
    assert personal.with_personal_data(spark.createDataFrame([], "doc_id long, text string")).collect() == []
