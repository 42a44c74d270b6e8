"""The training-data operators against brute force, and on awkward input."""

import hashlib
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bindmill.llm.hashing import RangeHash
from bindmill.llm import (decontamination, mixing, near_duplicates, pii, quality_model, quality_rules, repeats, sharding,
                          token_counts, urls)
from bindmill.llm.common import number_rows
from bindmill.llm.suffix_array import suffix_array

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, folder):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


# ---- sharding

@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 1000, 4097])
def test_permutation_is_a_bijection_with_an_inverse(n):
    places = sharding.permute(np.arange(n), n)
    assert sorted(places) == list(range(n))
    assert list(sharding.permute(places, n, back=True)) == list(range(n))


def test_shards_are_level_gapless_and_computable(spark, small):
    rows = sharding.op10_feistel_shards(spark, small).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    sizes = [len(slots[s]) for s in range(sharding.SHARDS)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    texts = dict(documents(spark, small))
    order = sorted(texts)
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)
        assert sharding.locate(order.index(r.doc_id), len(rows)) == (r.shard, r.slot)
        assert sharding.row_at(r.shard, r.slot, len(rows)) == order.index(r.doc_id)


def test_sharding_of_awkward_rows(edge_docs, no_docs):
    got = sharding.shard_rows(edge_docs, ["doc_id"], 4)
    assert got.columns == [*edge_docs.columns, "shard", "slot"] and got.count() == 10
    assert len({(r.shard, r.slot) for r in got.collect()}) == 10
    assert sharding.shard_rows(no_docs, ["doc_id"]).count() == 0


def test_row_numbers_do_not_depend_on_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 13).alias("a"), "id")
    want = [(r.n, r.a, r.id) for r in number_rows(df, [F.col("a"), F.col("id")], "n").orderBy("n").collect()]
    again = number_rows(df.repartition(3), [F.col("a"), F.col("id")], "n").orderBy("n").collect()
    assert [(r.n, r.a, r.id) for r in again] == want and [w[0] for w in want] == list(range(1000))


# ---- mixing

def water(sizes):
    """Targets by the stated rule, source by source."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, open_sources, left = {}, set(names), float(sum(sizes.values()))
    while open_sources:
        level = left / sum(weight[s] for s in open_sources)
        full = {s for s in open_sources if weight[s] * level > 3 * sizes[s]}
        if not full:
            return target | {s: weight[s] * level for s in open_sources}
        for s in full:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_sources -= full
    return target


def test_mix_targets_sizes_and_takings(spark, small):
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    sizes, largest = Counter(), Counter()
    for i, text in documents(spark, small):
        n = len(WORD.findall(text or ""))
        sizes[source[i]] += n
        largest[source[i]] = max(largest[source[i]], n)
    want, taken = water(sizes), Counter()
    rows = mixing.op4_pareto_mix(spark, small).collect()
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in sizes)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.op4_pareto_mix(spark, small).collect()))


def test_water_level_with_full_sources(spark):
    sizes = {"a": 1, "b": 1000, "c": 10, "é": 5, None: 300, "Z": 0}
    got = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()
    assert {r.source: pytest.approx(r.target) for r in got} == water(sizes)


def test_mixing_of_awkward_rows(edge_docs, no_docs):
    got = mixing.mix_documents(edge_docs)
    assert got.columns == edge_docs.columns and got.count() > 0 and mixing.mix_documents(no_docs).count() == 0


# ---- pseudonyms

def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d // 10 + d % 10
    return total % 10 == 0


def test_pseudonyms_keep_formats_and_links(spark):
    texts = ["card 4539 5787 6362 1486 and 4539578763621486.", "not a card: 4539578763621487", "on 2021-02-29 or 2020-02-29, 31/12/1999",
             "ip 10.2.33.4 but 300.1.1.1 and 1.02.3.4", "call +1 (017) 555-7713", "ssn 123-45-6789, not 000-45-6789",
             "write to Ann.B7@mail.example.com", 'token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce"', "", None, "version 4.0"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.pseudonymise(df).collect()}
    cards = [f.pseudonym for f in rows[0].found]
    assert [f.kind for f in rows[0].found] == ["card", "card"] and cards[0].replace(" ", "") == cards[1] and luhn(cards[1])
    assert re.fullmatch(r"\d{4} \d{4} \d{4} \d{4}", cards[0]) and rows[0].text == f"card {cards[0]} and {cards[1]}."
    assert [rows[k].text for k in (1, 8, 9, 10)] == [texts[k] for k in (1, 8, 9, 10)] and rows[9].found == []
    assert [f.value for f in rows[2].found] == ["2020-02-29", "31/12/1999"]
    assert [f.value for f in rows[3].found] == ["10.2.33.4"] and [f.value for f in rows[5].found] == ["123-45-6789"]
    assert re.fullmatch(r"call \+1 \(\d{3}\) \d{3}-\d{4}", rows[4].text) and rows[4].text != texts[4]
    assert re.fullmatch(r"write to [a-z0-9]{3}\.[a-z0-9]{2}@mail\.example\.com", rows[6].text)
    assert re.fullmatch(r'token = "[0-9a-f]{40}"', rows[7].text) and rows[7].text != texts[7]


def test_pseudonyms_of_common_forms(spark):
    """Cards between commas and in groups of 4-6-5, month-first dates, named secrets in other notations."""
    digest = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce"
    texts = ["id,4539578763621486,2024", "amex 3782 822463 10005, 3782-822463-10005", "not 3782 822463 10006", "0.4539578763621486 4539578763621486.5",
             "on 12/25/1999 or 25/12/1999, not 13/32/1999 or 02/30/2020", f'{{"token": "{digest}"}}', f"secret: '{digest.upper()}'",
             f"API_KEY={digest}", f"client_secret =\t{digest};", f"monkey={digest} broken key={digest}+ key={digest}-1"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.pseudonymise(df).collect()}
    assert [f.kind for f in rows[0].found] == ["card"] and luhn(rows[0].found[0].pseudonym)
    assert rows[0].text == f"id,{rows[0].found[0].pseudonym},2024" != texts[0]
    first, second = (f.pseudonym for f in rows[1].found)
    assert re.fullmatch(r"\d{4} \d{6} \d{5}", first) and first.replace(" ", "-") == second and luhn(first.replace(" ", ""))
    assert first != "3782 822463 10005" and [rows[k].text for k in (2, 3, 9)] == [texts[k] for k in (2, 3, 9)]
    assert [f.value for f in rows[4].found] == ["12/25/1999", "25/12/1999"]
    assert re.match(r"on (0\d|1[0-2])/(1[3-9]|[23]\d)/(19|20)\d\d or ", rows[4].text) and "12/25/1999" not in rows[4].text
    for k in (5, 6, 7, 8):
        assert [(f.kind, f.value.lower()) for f in rows[k].found] == [("secret", digest)]
        assert rows[k].text == texts[k].replace(rows[k].found[0].value, rows[k].found[0].pseudonym) != texts[k]
    days = spark.range(3000).select(F.date_format(F.date_add(F.lit("1950-01-01").cast("date"), F.col("id").cast("int")), "MM/dd/yyyy").alias("text"))
    got = {r.text: r.found[0].pseudonym for r in pii.pseudonymise(days.withColumn("was", F.col("text"))).select(F.col("was").alias("text"), "found").collect()}
    assert len(got) == len(set(got.values())) == 3000


def test_pseudonyms_are_one_to_one(spark):
    values = [f"10.0.{k // 256}.{k % 256}" for k in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "text string")
    assert len({r.text for r in pii.pseudonymise(df).collect()}) == 3000
    days = spark.range(3000).select(F.date_format(F.date_add(F.lit("1950-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("text"))
    assert len({r.text for r in pii.pseudonymise(days).collect()}) == 3000


def test_pseudonyms_of_awkward_rows(edge_docs, no_docs):
    got = pii.pseudonymise(edge_docs)
    assert {*got.columns} == {*edge_docs.columns, "found"} and got.count() == 10 and pii.pseudonymise(no_docs).count() == 0


def test_pseudonyms_of_very_long_runs(spark):
    """A million characters of every kind of pattern, and runs that stop just before they are one."""
    n = 10 ** 6
    runs = ["x@a" + ".a" * (n // 2), "a" * n, "a" * n + "@x.com", "a." * (n // 2) + "@x.com", "@" * n, "x@" * (n // 2), "x@a." * (n // 4), "1" * n,
            "1234 " * (n // 5), "1.2." * (n // 4), "12-" * (n // 3), "123-45-" * (n // 7), "01/02/" * (n // 6), "+1 " * (n // 3), "(123) " * (n // 6),
            "token=" * (n // 6), "f" * n, "token='" + "f" * n, "token" + " " * n + "=", "." * n, "-" * n, "%" * n]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(runs)], "doc_id int, text string")
    got = {r.doc_id: r for r in pii.pseudonymise(df).collect()}
    assert all(got[k].text == t for k, t in enumerate(runs) if not got[k].found) and len(got) == len(runs)
    assert [f.kind for f in got[0].found] == ["email"] and got[0].text[1:] == runs[0][1:]
    mixed = " ".join(["bob@x.com 123-45-6789 2020-02-29 10.2.33.4 4539578763621486"] * 1000)
    row = pii.pseudonymise(spark.createDataFrame([(mixed,)], "text string")).first()
    assert len(row.found) == 5000 and len({f.pseudonym for f in row.found}) == 5


def test_pseudonyms_are_valid_and_keep_values_apart(spark):
    numbers = [f"{900 + k // 30:03d}-{k % 30 + 1:02d}-{k % 7 + 1:04d}" for k in range(2900)]
    rows = pii.pseudonymise(spark.createDataFrame([(v, v) for v in numbers], "was string, text string")).collect()
    assert len({r.text for r in rows}) == len(set(numbers))
    assert all(re.fullmatch(r"(?!000)\d{3}-(?!00)\d\d-(?!0000)\d{4}", r.text) for r in rows)
    names = ["Bob", "bob", "BOB", "bOb1", "bob1", "rob", "Rob"]
    got = {r.was: r.text for r in pii.pseudonymise(spark.createDataFrame([(f"{x}@x.com",) * 2 for x in names], "was string, text string")).collect()}
    assert got["Bob@x.com"] == got["bob@x.com"] == got["BOB@x.com"] and got["bOb1@x.com"] == got["bob1@x.com"]
    assert len(set(got.values())) == len({x.lower() for x in names}) == 3


# ---- urls

def test_url_of_many_parts_ends(spark):
    """Sixty tokens that stand in the same urls are one item, and any of them brings its rules."""
    many = [f"path:{k}" for k in range(60)]
    rows = [(many + ["a"], "block")] * 12 + [(many + ["b"], "block")] * 8 + [(["a", "c"], "allow")] * 10 + [(["b", "c"], "allow")] * 10
    rules, merged = urls.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.1, 0.8, min_urls=10)
    first = {r.token: r.item for r in merged.collect()}
    assert {first[t] for t in many} == {"path:0"} and first["c"] == "c" and len(first) == 63
    got = {(tuple(r.antecedent), r.verdict): (r.confidence, round(r.support * 40)) for r in rules.collect()}
    assert got == {(("path:0",), "block"): (1.0, 20), (("c",), "allow"): (1.0, 20)}
    pages = [(k, "http://a.net/" + "/".join(f"p{i}" for i in range(60))) for k in range(30)] + [(99, "http://b.io/p7/zz"), (100, "http://b.io/zz")]
    judged = {r.page_id: r.verdict for r in urls.judge_urls(spark.createDataFrame(pages, "page_id int, url string")).collect()}
    assert judged[0] == judged[99] == "block" and len(judged) == 32


def test_merged_rules_equal_those_of_all_tokens(spark):
    """Judging by items gives what judging by every frequent combination of tokens gives."""
    draw = random.Random(3)
    rows = []
    for _ in range(60):
        tokens = {t for t in "abcdef" if draw.random() < 0.5}
        tokens |= {"a2", "a3"} if "a" in tokens else set()
        rows.append((sorted(tokens), "block" if len(tokens & set("abc")) > 1 else "allow"))
    plain = []
    names = ["a", "a2", "a3", *"bcdef"]
    for size in range(1, 9):
        for part in combinations(names, size):
            inside = [v for t, v in rows if set(part) <= set(t)]
            for verdict in ("allow", "block"):
                both = inside.count(verdict)
                if both >= 5 and both / len(inside) >= 0.8:
                    plain.append((both / len(inside), both / 60, size, verdict, list(part)))
    rules, merged = urls.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 5 / 60, 0.8)
    asked = [sorted(x) for x in {tuple(t for t in names if draw.random() < 0.4) for _ in range(80)} if x]
    sets = spark.createDataFrame([(x,) for x in asked], "tokens array<string>")
    got = {tuple(r.tokens): r.mined for r in urls._match(urls.items_of(sets, merged, "tokens").select("tokens", "items"), rules).collect()}
    for x in asked:
        fitting = [p for p in plain if set(p[4]) <= set(x)]
        best = max(fitting)[:2] if fitting else None
        assert (got.get(tuple(x)) is None) == (best is None)
        if best:
            assert got[tuple(x)] in {p[3] for p in fitting if p[:2] == best}


def test_url_parts_and_fixed_rules(spark):
    cases = {"http://Sub.Example.NET/en/1?x#y": ("sub.example.net", "/en/1", "example.net/en/"), "https://a.net": ("a.net", "", None),
             "https://a.net/": ("a.net", "/", "net/"), "x://evilnet/": ("evilnet", "/", None), "http://example.com/de/?q": ("example.com", "/de/", "example.com/de/"),
             "http://a.org/fr/9": ("a.org", "/fr/9", "org/fr/"), "no scheme": ("", "", None), "": ("", "", None), None: ("", "", None),
             "a://b://c/d": ("b:", "//c/d", None), "http://ÄB.net/x": ("Äb.net", "/x", "net/")}
    df = spark.createDataFrame([(k, u) for k, u in enumerate(cases)], "page_id long, url string")
    got = {r.url: r for r in urls.judge_urls(df).collect()}
    assert {u: (r.host, r.path, r.rule) for u, r in got.items()} == cases
    says = dict(urls.RULES)
    assert all(r.verdict == says[r.rule] for r in got.values() if r.rule) and {r.verdict for r in got.values()} <= {"allow", "block"}


def test_mined_rules_equal_counting(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url")
    host, path = urls.url_parts(F.col("url"))
    rows = pages.select(urls.fixed_rule(host, path)[1].alias("verdict"), urls.url_tokens(F.col("url"), host, path).alias("tokens"))
    known = [(set(r.tokens), r.verdict) for r in rows.collect() if r.verdict]
    mined = urls.mine_rules(rows.where("verdict is not null"), 0.02, 0.8).collect()
    assert mined
    for r in mined:
        fits = [v for t, v in known if set(r.antecedent) <= t]
        assert r.confidence == pytest.approx(fits.count(r.verdict) / len(fits)) and r.index_token in r.antecedent
        assert r.confidence >= 0.8 and fits.count(r.verdict) >= 0.02 * len(known)
    assert urls.judge_urls(pages.limit(0)).count() == 0


def test_rules_of_any_length_are_mined(spark):
    every = ["a", "b", "c", "d", "e"]
    rows = [(every, "block")] * 10 + [([t for t in every if t != left_out], "allow") for left_out in every for _ in range(10)]
    mined = urls.mine_rules(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.02, 0.85)
    assert [(r.antecedent, r.verdict, r.confidence) for r in mined.collect()] == [(every, "block", 1.0)]
    sets = spark.createDataFrame([(every + ["f"],), (every[:4],)], "tokens array<string>")
    assert [(r.tokens, r.mined) for r in urls.match_rules(sets, mined).collect()] == [(every + ["f"], "block")]


# ---- distribution rules

def test_base_counts_equal_brute_force(spark, small):
    got = {r.doc_id: r for r in quality_rules.op8_distribution_rules(spark, small).collect()}
    for i, text in documents(spark, small):
        words = WORD.findall(text or "")
        windows = Counter(tuple(words[k:k + 3]) for k in range(len(words) - 2))
        inside = {k + d for k in range(len(words) - 2) if windows[tuple(words[k:k + 3])] > 1 for d in range(3)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        r, failed = got[i], len(words) < 50 or 100 * len(inside) > 50 * len(words)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (
            len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside), failed)
        assert not (failed and r.kept)


def _plain_shares(counts):
    total = sum(counts)
    return [c / total for c in counts] if total else None


def _plain_distance(p, q):
    if p is None or q is None:
        return None
    m = [(a + b) / 2 for a, b in zip(p, q)]
    return max(0.0, sum(x * np.log2(x / y) for d in (p, q) for x, y in zip(d, m) if x > 0) / 2) ** 0.5


def test_verdicts_equal_brute_force(spark, small, edge_docs):
    """``kept`` of whole tables, from plain histograms of every language."""
    table = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang", "source")
    for docs in (table, edge_docs.select("doc_id", "text", "lang", "source")):
        rows = [(r.doc_id, r.lang, r.text or "") for r in docs.collect()]
        classes, words = defaultdict(lambda: [0] * 5), defaultdict(Counter)

        def count_classes(text):
            chars = [c for w in WORD.findall(text) for c in w]
            kinds = [0 if unicodedata.category(c) == "Lu" else 1 if unicodedata.category(c)[0] == "L" else 2 if unicodedata.category(c) == "Nd"
                     else 3 if c in "#*$%&|<>" else 4 for c in chars]
            return [kinds.count(k) for k in range(5)]

        for _, lang, text in rows:
            classes[lang] = [a + b for a, b in zip(classes[lang], count_classes(text))]
            words[lang].update(WORD.findall(text.lower()))
        want = Counter()
        for i, lang, text in rows:
            top = sorted(((-n, w) for w, n in words[lang].items() if len(w) <= 5))[:16]
            total = sum(words[lang].values())
            said = WORD.findall(text)
            own = Counter(WORD.findall(text.lower()))
            mine = [own[w] for _, w in top]
            windows = Counter(tuple(said[k:k + 3]) for k in range(len(said) - 2))
            inside = {k + d for k in range(len(said) - 2) if windows[tuple(said[k:k + 3])] > 1 for d in range(3)}
            failed = len(said) < 50 or 100 * len(inside) > 50 * len(said)
            reference = [-n for n, _ in top]
            near = [_plain_distance(_plain_shares(count_classes(text)), _plain_shares(classes[lang])),
                    _plain_distance(_plain_shares(mine + [len(said) - sum(mine)]), _plain_shares(reference + [total - sum(reference)]))]
            far = [d is not None and d > limit for d, limit in zip(near, (quality_rules.MAX_CLASS_DISTANCE, quality_rules.MAX_WORD_DISTANCE))]
            want[(i, failed, not failed and not any(far))] += 1
        assert Counter((r.doc_id, r.base_failed, r.kept) for r in quality_rules.judge_documents(docs).collect()) == want


def test_distance_is_jensen_shannon(spark):
    p, q = [0.5, 0.5, 0.0], [0.25, 0.25, 0.5]
    row = spark.range(1).select(quality_rules.distance(F.array(*map(F.lit, p)), F.array(*map(F.lit, q)))).first()[0]
    m = [(a + b) / 2 for a, b in zip(p, q)]
    want = sum(x * np.log2(x / y) for d in (p, q) for x, y in zip(d, m) if x > 0) / 2
    assert row == pytest.approx(np.sqrt(want))


def test_distribution_rules_on_awkward_rows(edge_docs, no_docs):
    got = quality_rules.judge_documents(edge_docs)
    assert got.count() == 10 and set(edge_docs.columns) <= set(got.columns)
    assert all(r.base_failed and not r.kept for r in got.where("n_words = 0").collect())
    assert quality_rules.judge_documents(no_docs).count() == 0


# ---- string tiling

def test_tiles_cover_reordered_passages():
    item = list(range(1, 41))
    text = [99] * 7 + item[20:] + [98] * 3 + item[:20] + [97] * 5
    tiles = decontamination.tile(text, item, [(0, len(text))])
    assert sorted((i, n) for _, i, n in tiles) == [(0, 20), (20, 20)]
    assert all(text[t:t + n] == item[i:i + n] for t, i, n in tiles)


def test_tiling_equals_repeated_search():
    rng = random.Random(3)
    for _ in range(150):
        item = [rng.randint(1, 4) for _ in range(rng.randint(5, 30))]
        text = [rng.randint(1, 4) for _ in range(rng.randint(0, 60))] + item[rng.randint(0, 5):]
        tiles = decontamination.tile(text, item, [(0, len(text))])
        assert all(n >= 5 and text[t:t + n] == item[i:i + n] for t, i, n in tiles)
        for side in (0, 1):  # no word lies under two tiles
            places = [t[side] + k for t in tiles for k in range(t[2])]
            assert len(places) == len(set(places))
        left_t = {t + k for t, _, n in tiles for k in range(n)}
        left_i = {i + k for _, i, n in tiles for k in range(n)}
        for t in range(len(text) - 4):  # and nothing that could be a tile is left
            for i in range(len(item) - 4):
                free = not any(t + k in left_t or i + k in left_i for k in range(5))
                assert not (free and text[t:t + 5] == item[i:i + 5])


def test_leaks_against_plain_search(spark, small, edge_docs, no_docs, monkeypatch):
    items = spark.read.parquet(f"{small}/benchmark.parquet")
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    got = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(docs, items).collect()}
    joined = {r.item_id: " ".join(decontamination.tokens(r.text)) for r in items.collect()}
    whole = {(i, k) for i, t in documents(spark, small) for k, v in joined.items() if f" {v} " in f" {' '.join(decontamination.tokens(t))} "}
    assert whole and whole <= got
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 2000)  # several blocks
    assert {(r.doc_id, r.item_id) for r in decontamination.find_leaks(docs, items).collect()} == got
    kept = decontamination.drop_leaks(edge_docs, items)
    assert kept.columns == edge_docs.columns and kept.count() == 10 and decontamination.drop_leaks(no_docs, items).count() == 0
    assert decontamination.find_leaks(docs, items.limit(0)).count() == 0


def test_leaks_equal_tiling_of_every_pair(spark, small):
    """The seeds lose no pair: every text tiled with every item, repeated seeds and equal items among them."""
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    items += [(90_000, "one two three four five " * 8), (90_001, "one two three four five " * 8), (90_002, "a b c d"), (90_003, None),
              (90_004, "alpha beta gamma delta epsilon zeta eta theta iota kappa")]
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    texts += [(80_000, "one two three four five " * 5), (80_001, "six one two three four five"), (80_002, "alpha beta gamma delta epsilon"),
              (80_003, "eta theta iota kappa x alpha beta gamma delta"), (80_004, None), (80_004, "alpha beta gamma delta epsilon")]
    every = decontamination.Items([i for i in items if i[1]], decontamination.MIN_COVERAGE)
    want = sorted((i, leak["item"], leak["covered"]) for i, t in texts for leak in every.leaks(t))
    got = decontamination.find_leaks(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id, r.covered_words) for r in got.collect()) == want and len(want) > 5


# ---- quality classifier

def test_machine_pairs_equal_the_double_sum():
    machine = quality_model.Machine()
    machine.weights[:] = np.random.default_rng(0).normal(size=len(machine.weights))
    numbers, values = quality_model.features("some words of a text\nand a line")
    plain = machine.bias + machine.weights[numbers] @ values + sum(
        machine.factors[i] @ machine.factors[j] * x * y
        for a, (i, x) in enumerate(zip(numbers, values)) for j, y in list(zip(numbers, values))[a + 1:])
    assert machine.raw(numbers, values) == pytest.approx(plain)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"  # 3,155 labels to learn from, 825 held out
    scored = quality_model.op2_factorisation_machine(spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.98 and scored.count() == 10_000


def test_classifier_on_awkward_rows(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (6, None), (7, 1), (3, 5)], "doc_id long, quality int")
    kept = quality_model.keep_good(edge_docs, labels, 0.0)
    assert kept.columns == edge_docs.columns and kept.count() == 10
    assert quality_model.keep_good(no_docs, labels.limit(0)).count() == 0


# ---- section tokens

def test_sections_add_up_and_follow_the_rule(spark, small):
    encoding, lengths = token_counts.encoder(open(token_counts.VOCABULARY, "rb").read())
    rows = defaultdict(list)
    for r in token_counts.op3_section_tokens(spark, small).collect():
        rows[r.doc_id].append(r)
    for i, text in documents(spark, small):
        data, own = (text or "").encode(), sorted(rows[i], key=lambda r: r.section)
        assert [data[r.start:r.start + r.bytes] for r in own] == [x for x in data.splitlines(keepends=True)] or b"\r" in data or b"\x0b" in data or not data
        want, at = Counter(), 0
        for token in encoding.encode_ordinary(text or ""):
            end = at + int(lengths[token])
            shares = [(min(end, r.start + r.bytes) - max(at, r.start), -r.section) for r in own]
            want[-max(shares)[1]] += 1
            at = end
        assert at == len(data) and {r.section: r.n_tokens for r in own if r.n_tokens} == dict(want)


def test_crossing_tokens():
    ends = np.array([4, 6, 20])
    tokens = np.array([3, 7, 20])  # the second token holds one byte of the first section, two of the second, one of the third
    assert token_counts.deal(tokens, ends, "majority")[0].tolist() == [1, 1, 1]
    assert token_counts.deal(tokens, ends, "start")[0].tolist() == [2, 0, 1]
    assert token_counts.deal(np.array([2, 6]), np.array([4, 6]), "majority")[0].tolist() == [2, 0]  # a tie: the earlier


def test_section_tokens_on_awkward_rows(edge_docs, no_docs):
    got = token_counts.count_tokens(edge_docs, ["source", "text"])
    assert {r.doc_id for r in got.collect()} == {1, 2, 3, 4, 5, 6, 7, None} and token_counts.count_tokens(no_docs, ["text"]).count() == 0


# ---- near-duplicates

def test_signatures_are_unbiased():
    rng, errors = np.random.default_rng(1), []
    for _ in range(40):
        n = int(rng.integers(3, 50))
        a = rng.integers(0, 9, n)
        b = np.where(rng.random(n) < 0.6, a, rng.integers(0, 9, n))
        element = rng.integers(0, 2 ** 63, n).astype(np.uint64)
        owner = np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()])
        s = near_duplicates.bag_minhash(owner, np.concatenate([element[a > 0], element[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, 600)
        errors.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / max(1, np.maximum(a, b).sum()))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.03


def bag(text):
    words = WORD.findall(text or "")
    width = min(5, len(words))
    return Counter(tuple(words[k:k + width]) for k in range(len(words) - width + 1)) if words else Counter()


def classes(rows):
    """Smallest id of each class by comparing all pairs that share a shingle."""
    bags, where, root = {i: bag(t) for i, t in rows}, defaultdict(set), {i: i for i, _ in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, t in rows:
        near = {j for s in bags[i] for j in where[s]} | {j for j, u in rows if u == t and j < i}
        for j in near:
            common = sum((bags[i] & bags[j]).values())
            if (rows_text := dict(rows))[i] == rows_text[j] or common >= 0.8 * (sum(bags[i].values()) + sum(bags[j].values()) - common) > 0:
                a, b = sorted((top(i), top(j)))
                root[b] = a
        for s in bags[i]:
            where[s].add(i)
    return {i: top(i) for i, _ in rows}


def test_classes_equal_brute_force(spark, small):
    got = {r.doc_id: r.class_id for r in near_duplicates.op7_bag_minhash(spark, small).collect()}
    assert got == classes(documents(spark, small))


def test_drifting_copies_form_the_same_classes(spark):
    rng, text, rows = random.Random(5), [f"w{k}" for k in range(60)], []
    for i in range(160):
        base = rows[rng.randrange(len(rows))][1].split() if rows else text
        copy = list(base)
        copy[rng.randrange(len(copy))] = f"x{i}"
        rows.append((i, " ".join(copy)))
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == classes(rows)


def test_elements_give_the_overlap_of_multisets():
    hashes, rng = RangeHash(), np.random.default_rng(3)
    texts = [" ".join(rng.choice(["a", "b", "c"], 80)) for _ in range(12)]
    bags = [near_duplicates.shingles(t, hashes) for t in texts]
    for a in bags:
        for b in bags:
            exact = near_duplicates.overlap(a, b)
            sets = near_duplicates.elements(a), near_duplicates.elements(b)
            assert near_duplicates._alike_sets(*sets, exact)
            assert exact == 1 or not near_duplicates._alike_sets(*sets, exact + 1e-6)


@pytest.mark.parametrize("words", [300, 2600])
def test_near_duplicates_of_a_drifting_group(spark, words):
    """Copies that differ in more and more places, so that many pairs lie on both sides of the threshold."""
    rng, hashes = np.random.default_rng(words), RangeHash()
    base = [f"w{i}" for i in rng.integers(0, 5000, words)]
    rows = []
    for k in range(90):
        text = list(base)
        for at in rng.choice(words, int(words * rng.uniform(0.005, 0.04)), replace=False):
            text[at] = f"x{k}-{at}"
        rows.append((k, " ".join(text)))
    bags = [near_duplicates.shingles(t, hashes) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if near_duplicates.overlap(bags[i], bags[j]) >= 0.8:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == dict(enumerate(root))
    assert 1 < len(set(root)) < 85


def test_near_duplicates_of_awkward_rows(edge_docs, no_docs):
    got = near_duplicates.near_duplicates(edge_docs).collect()
    assert len(got) == 10 and {r.class_id for r in got if r.doc_id in (1, 2)} == {1} and {r.class_id for r in got if r.doc_id in (3, 4)} == {3}
    kept = near_duplicates.drop_near_duplicates(edge_docs)
    assert kept.columns == edge_docs.columns and sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [1, 3, 5, 6, 7]
    assert kept.count() == 6 and near_duplicates.drop_near_duplicates(no_docs).count() == 0


# ---- repeats

def test_suffix_array_equals_sorting():
    rng = random.Random(7)
    for _ in range(1500):
        text = [rng.randint(1, rng.choice([1, 2, 3, 20])) for _ in range(rng.randint(0, 40))]
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def without_repeats(rows):
    seen, out = set(), {}
    for i, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - 99):
            window = data[s:s + 100]
            if window in seen:
                gone[s:s + 100] = b"\1" * 100
            seen.add(window)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out[i] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def removed(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in df.collect()}


def test_repeats_equal_brute_force(spark, small, monkeypatch):
    rows = sorted(documents(spark, small))
    period = "ab" * 400 + "tail " + "x" * 700
    rows += [(10_000, period), (10_001, "front " + period[100:]), (10_002, ""), (10_003, None), (10_004, "y" * 99), (10_005, "é" * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = without_repeats(rows)
    assert removed(repeats.remove_repeats(df)) == want
    monkeypatch.setattr(repeats, "GROUP", 2)  # most groups are dealt anew by longer runs
    assert removed(repeats.remove_repeats(df)) == want


def test_repeats_of_awkward_rows(spark, edge_docs, no_docs):
    got = repeats.remove_repeats(edge_docs).collect()
    assert len(got) == 10
    assert {(r.n_removed, r.n_bytes) for r in got if r.doc_id == 2} == {(264, 264)}  # both rows repeat document 1
    assert repeats.remove_repeats(no_docs).count() == 0


def test_packed_sketches_count_equal_components():
    """op7: components of fine sketches are counted sixteen at a time, as one by one."""
    draw = np.random.default_rng(5)
    bits = draw.integers(0, 16, (40, near_duplicates.FINE_SIZE)).astype(np.uint8)
    bits[1:30, :1600] = bits[0, :1600]
    packed = near_duplicates._packed(pd.Series([(row[::2] << 4 | row[1::2]).tobytes() for row in bits]))
    assert near_duplicates._agreeing(packed, packed[0]).tolist() == (bits == bits[0]).sum(axis=1).tolist()


def test_pairs_are_checked_once(spark, monkeypatch):
    """op7: one Python evaluation in a task of the exact check, so no second worker holds the same texts."""
    monkeypatch.setattr(near_duplicates, "durable", lambda df: df)
    text = " ".join(f"w{i}" for i in range(30))
    texts = spark.createDataFrame([("a", text), ("b", text + " x"), ("c", "other")], "key string, text string")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c")], "a string, b string")
    links = near_duplicates._similar(pairs, texts, 0.8)
    assert [(r.a, r.b) for r in links.collect()] == [("a", "b")]
    assert links._jdf.queryExecution().sparkPlan().toString().count("ArrowEvalPython") == 1


@pytest.mark.parametrize("sketch", ["signature", "fine_sketch"])
def test_signatures_of_long_texts_are_made_in_bounded_parts(monkeypatch, sketch):
    """op7: the shingles held at once are bounded, however long the texts of a batch are; the rows are those of each text."""
    rng, sizes, inner = np.random.default_rng(7), [], near_duplicates.bag_minhash
    texts = [" ".join(f"word{i}" for i in rng.integers(0, 5000, n)) for n in [20_000] * 12 + [200_000] + [40] * 60] + [""]
    monkeypatch.setattr(near_duplicates, "bag_minhash", lambda owner, *args: (sizes.append(len(owner)), inner(owner, *args))[1])
    make = getattr(near_duplicates, sketch).func
    got = pd.concat(make(iter([pd.Series(texts)])), ignore_index=True)
    assert max(sizes) <= 200_000 and sorted(sizes)[-2] <= 60_000
    for k in (0, 11, 12, 13, 72, 73):
        alone = next(iter(make(iter([pd.Series([texts[k]])]))))
        assert got.iloc[k].tolist() == alone.iloc[0].tolist()
    assert len(got) == len(texts)
