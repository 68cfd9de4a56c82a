"""The quality model cut to its most frequent n-grams, with the statistics of all."""

import collections

import numpy as np
import pytest

from helixframe.llm import quality_rules as rules
from helixframe.llm.kernel import chunks

TEXTS = ["der die das und der die das nicht", "the cat sat on the mat and the cat ran", "abc abd abe abf " * 9, "", "zzz", "ein Text, ein Text; noch 1 Text!"] * 2


def prepared(spark):
    docs = rules.with_lang(spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").repartition(3))
    letters = rules.alphabet(docs, 14)
    return letters, rules.written(rules.coded(docs, letters, "doc_id"), "coded")


def all_codes(letters):
    import pyarrow as pa

    chunk = next(chunks(pa.array(TEXTS)))
    return rules.codes(*rules.symbols(chunk, letters))


def brute(codes, n_letters, most):
    """p of a code of any order by dictionaries."""
    mask = lambda n: (1 << rules.BITS * n) - 1
    table = collections.Counter(codes)
    orders = {}
    for n in range(rules.ORDER, 0, -1):
        if n < rules.ORDER:
            table = collections.Counter(k & mask(n) for k in table)
        cut = rules.discounts(np.array(list(table.values())))
        levels = {k: int(8 * np.log2(c)) for k, c in table.items()}
        least = next(x for x in range(513) if sum(v >= x for v in levels.values()) <= most)
        taken = {k: min(cut[min(c, 3)], c) for k, c in table.items()}
        total, spare = collections.Counter(), collections.Counter()
        for k, c in table.items():
            total[k >> rules.BITS] += c
            spare[k >> rules.BITS] += taken[k]
        kept = {k: (table[k] - taken[k]) / total[k >> rules.BITS] for k in table if levels[k] >= least}
        left = {k >> rules.BITS: spare[k >> rules.BITS] / total[k >> rules.BITS] for k in kept}
        given = dict(left)
        for k in table:
            if k not in kept and k >> rules.BITS in left:
                left[k >> rules.BITS] += (table[k] - taken[k]) / total[k >> rules.BITS]
        orders[n] = kept, given, left

    def p(code, n=rules.ORDER):
        if not n:
            return 1 / (n_letters + 1)
        kept, given, left = orders[n]
        lower = p(code & mask(n - 1), n - 1)
        if code in kept:
            return kept[code] + given[code >> rules.BITS] * lower
        return left.get(code >> rules.BITS, 1.0) * lower

    return p


@pytest.mark.parametrize("most", [5, 40, 90])
def test_a_cut_model_equals_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(rules, "MOST_GRAMS", most)
    letters, rows = prepared(spark)
    model = rules.trained(letters, rows)
    codes = all_codes(letters)
    unseen = np.array([1 << 50, 3, (5 << 12) + 4], np.uint64)
    p = brute([int(c) for c in codes], len(letters), most)
    wanted = np.unique(np.concatenate([codes, unseen]))
    assert all(len(k) <= most for k in model.keys) and len(np.unique(codes)) > most
    assert np.allclose(model.losses(wanted), [-np.log(p(int(c))) for c in wanted], atol=1e-5)


def test_orders_that_are_not_cut_make_the_whole_model(spark):
    letters, rows = prepared(spark)
    whole = rules.trained(letters, rows)
    grams, buckets = rules.gram_table(rows)
    orders = [rules.cut_order(grams, *rules.tally(grams))]
    for n in range(rules.ORDER - 1, 0, -1):
        grams = rules.summed_grams(grams, lambda batch, n=n: (np.unique(rules.unpack_sorted(x.as_py()) & np.uint64((1 << rules.BITS * n) - 1), return_counts=True) for x in batch.column(0)), buckets)
        orders.append(rules.cut_order(grams, *rules.tally(grams)))
    cut = rules.joined_orders(letters, orders[::-1])
    codes = np.unique(all_codes(letters))
    assert [k.tolist() for k in cut.keys] == [k.tolist() for k in whole.keys]
    assert np.allclose(cut.losses(codes), whole.losses(codes), atol=1e-5)


def test_a_document_is_summed_by_itself():
    draw = np.random.default_rng(1)
    losses, bounds = draw.uniform(0, 9, 5000), np.array([0, 0, 7, 7, 4000, 5000, 5000])
    whole = rules.mean_losses(losses, bounds)
    for a, b, got in zip(bounds[:-1], bounds[1:], whole):
        alone = rules.mean_losses(losses[a:b], np.array([0, b - a]))[0]
        assert got == alone or np.isnan(got) and np.isnan(alone) and a == b
