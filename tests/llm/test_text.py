import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sitewright.llm import decontaminate, line_dedup, ngram_join, pii
from sitewright.llm.graph import components

WORDS = [f"w{i}" for i in range(400)]


def prose(choose, n):
    return " ".join(choose.choice(WORDS) for _ in range(n))


# Line deduplication


def removed(docs):
    return {(r.doc_id, r.version, n) for r in line_dedup.repeats(docs).collect() for n in range(r.start, r.stop)}


def test_repeated_passages_stay_once_and_nothing_else_goes(docs_of):
    choose = random.Random(5)
    passages = [[prose(choose, choose.randint(12, 40)) for _ in range(6)] for _ in range(5)]
    long_line = prose(choose, 70)
    rows = []
    for i in range(60):
        lines = [prose(choose, choose.randint(3, 30)) for _ in range(choose.randint(2, 12))]
        if i % 3:
            at = choose.randint(0, len(lines))
            lines[at:at] = passages[i % 5]
        if i % 4 == 0:
            lines.insert(choose.randint(0, len(lines)), long_line)
        rows.append((i, "\n".join(lines)))
    left = {r.doc_id: r for r in line_dedup.remove_repeats(docs_of(rows, extra=("lines", "hash", "start", "lines_removed"))).collect()}
    before = Counter(line for _, t in rows for line in t.split("\n"))
    after = Counter(line for r in left.values() for line in r.text.split("\n"))
    assert set(after) - {""} == set(before)
    assert all(after[line] == n for line, n in before.items() if n == 1)
    assert after[long_line] == 1
    assert sum(after[line] for p in passages for line in p) <= 1.2 * sum(map(len, passages))
    for i, t in rows:
        kept = iter(t.split("\n"))
        assert all(any(line == k for k in kept) for line in left[i].text.split("\n") if left[i].text)  # order is kept
        assert len(t.split("\n")) - left[i].lines_removed == (len(left[i].text.split("\n")) if left[i].text else 0)


def test_line_dedup_edges(docs_of):
    whole = "one two three\nfour five six\nseven eight nine\nten"
    long_line = "word " * 60
    rows = [(1, whole), (2, whole), (2, whole), (3, None), (4, ""), (5, "\n\n\n"), (None, whole), (6, "single"), (7, "single"), (8, long_line), (8, "x\n" + long_line), (9, "a\n" * 30_000)]
    got = line_dedup.remove_repeats(docs_of(rows)).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append((r.text, r.lines_removed))
    assert by[None] == [(whole, 0)] and by[1] == [("", 4)]  # a null id comes first
    assert by[2] == [("", 4), ("", 4)]
    assert by[3] == [(None, 0)] and by[4] == [("", 0)]
    assert by[6] == [("single", 0)] and by[7] == [("single", 0)]
    assert sorted(n for _, n in by[8]) == [0, 1]
    assert line_dedup.remove_repeats(docs_of([])).count() == 0


def test_chunks_do_not_shift(docs_of):
    choose = random.Random(9)
    passage = [prose(choose, 8) for _ in range(40)]
    rows = [(i, "\n".join([prose(choose, 5) for _ in range(i)] + passage)) for i in range(6)]
    found = line_dedup.chunks(docs_of(rows)).collect()
    inner = Counter(r.hash for r in found)
    assert sum(1 for n in inner.values() if n == 6) >= 10


# Decontamination


def plain_containment(docs, items, percent=80):
    def split(t):
        return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]

    out = set()
    for j, q in items:
        w = split(q)
        k = min(5, len(w))
        own = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
        for i, t in docs:
            d = split(t)
            there = {tuple(d[a : a + k]) for a in range(len(d) - k + 1)}
            if own and 100 * len(own & there) >= percent * len(own):
                out.add((i, j, len(own & there), len(own)))
    return out


def test_contained_items_are_found_whole_or_in_part(spark, docs_of):
    choose = random.Random(11)
    items = [(j, prose(choose, n)) for j, n in enumerate([1, 2, 3, 4, 5, 6, 7, 9, 15, 16, 17, 31, 32, 33, 60, 120])] + [(90, None), (91, ""), (92, "!?")]
    rows = []
    for i in range(120):
        words = prose(choose, choose.choice([0, 3, 40, 3000])).split()
        own = items[i % 16][1].split()
        for _ in range(choose.choice([0, 0, 1, 2, 5])):
            own[choose.randrange(len(own))] = "changed"
        at = choose.randint(0, len(words))
        words[at:at] = own
        rows.append((i, (", " if i % 2 else " ").join(words).upper() if i % 5 == 0 else "\n".join(words)))
    rows += [(500, None), (501, ""), (7, items[12][1]), (7, items[12][1])]
    tests = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_shared, r.n_shingles) for r in decontaminate.contained(docs_of(rows, extra=("words", "version", "hash")), tests).collect()}
    want = plain_containment(rows, items)
    assert got == want and len({i for i, *_ in want}) > 40
    clean = decontaminate.clean(docs_of(rows), tests)
    dirty = {i for i, *_ in want}
    assert {r.doc_id for r in clean.collect()} >= {i for i, _ in rows if i not in dirty}
    assert decontaminate.contained(docs_of([]), tests).count() == 0
    assert decontaminate.contained(docs_of(rows), tests.limit(0)).count() == 0
    assert decontaminate.clean(docs_of(rows), tests.limit(0)).count() == len(rows)


# N-gram join


def plain_components(rows, width, percent):
    def own(t):
        w = (t or "").lower().split()
        return frozenset(zip(*(w[i:] for i in range(min(width, len(w)))))) if w else frozenset()

    sets = [own(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = d if least.get(r) is None else (least[r] if d is None else min(least[r], d))
    return sorted(((str(d), len(sets[i]), str(least[find(i)])) for i, (d, _) in enumerate(rows)))


@pytest.mark.parametrize("width,percent,cluster", [(3, 90, 16_384), (5, 80, 16_384), (5, 80, 3)])
def test_components_equal_all_pairs(docs_of, monkeypatch, width, percent, cluster):
    monkeypatch.setattr(ngram_join, "BLOCK", 4)  # so that clusters take several blocks
    choose = random.Random(width)
    rows, i = [], 0
    for n in [1, 2, 3, 5, 11, 12, 13, 20, 21, 22, 40, 60, 150, 400]:
        for _ in range(3):
            base = prose(choose, n).split()
            for _ in range(6):
                w = base[:]
                for _ in range(choose.choice([0, 0, 1, 1, 2, max(1, n // 25)])):
                    at = choose.randrange(len(w))
                    w[at : at + 1] = choose.choice([[], ["new"], ["more", "words"]]) or [w[at]]
                if choose.random() < 0.3 and len(w) > 2:
                    w = w[: -max(1, n // 30)]
                rows.append((i, " ".join(w)))
                i += 1
    rows += [(900, None), (901, ""), (902, " \n"), (0, rows[0][1]), (3, "quite another text of its own"), (None, rows[5][1]), (None, "alone with no id")]
    choose.shuffle(rows)
    got = ngram_join.link_components(docs_of(rows, extra=("n", "key", "row", "segments")), width, percent, cluster)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got.collect()) == plain_components(rows, width, percent)


def test_a_large_group_of_near_copies(docs_of):
    choose = random.Random(2)
    base = prose(choose, 150).split()
    rows = []
    for i in range(700):
        w = base[:]
        w[choose.randrange(150)] = f"new{i}"
        rows.append((i + 1, " ".join(w)))
    for cluster in (16_384, 100):
        got = ngram_join.link_components(docs_of(rows), 3, 90, cluster).collect()
        assert {r.component_id for r in got} == {1}
    kept = ngram_join.keep_one(docs_of(rows + [(9000, ""), (9001, None), (1, rows[0][1])]), 3, 90).collect()
    assert sorted(r.doc_id for r in kept) == [1, 9000, 9001]
    assert ngram_join.link_components(docs_of([]), 3, 90).count() == 0
    assert ngram_join.keep_one(docs_of([]), 3, 90).count() == 0


def test_segments_of_linked_sets_meet():
    import numpy as np

    choose = np.random.default_rng(1)
    bounds = ngram_join.starts(90, 5000)
    for n in [10, 11, 19, 20, 50, 99, 100, 101, 333, 1000]:
        for _ in range(30):
            a = np.unique(choose.integers(0, 2**63, n).astype(np.uint64))
            b = a.copy()
            edits = int(choose.integers(0, n // 10 + 1))
            b[choose.choice(len(b), edits, replace=False)] = choose.integers(0, 2**63, edits).astype(np.uint64)
            b = np.unique(b[int(choose.integers(0, max(1, n // 20))) :])
            both = len(np.intersect1d(a, b))
            if 100 * both >= 90 * (len(a) + len(b) - both):
                for share in (0, 0.1, 0.5, 0.9):
                    hot = np.sort(choose.choice(np.union1d(a, b), int(share * len(a)), replace=False))
                    assert len(np.intersect1d(ngram_join.segments(a, 90, bounds, hot), ngram_join.segments(b, 90, bounds, hot)))
                assert list(ngram_join.Index([b], 90).search(a)) == [0]
            else:
                assert list(ngram_join.Index([b], 90).search(a)) == []


def test_segments_of_sets_of_any_size_meet():
    import numpy as np

    choose = np.random.default_rng(5)
    for percent in (50, 80, 90):
        bounds = ngram_join.starts(percent, 5000)
        for n in [1, 2, 3, 4, 5, 7, 9, 15, 16, 17, 30, 64, 120, 121, 122, 250, 700]:
            linked = 0
            for _ in range(60):
                a = np.unique(choose.integers(0, 2**63, n).astype(np.uint64))
                gone, new = (int(choose.integers(0, n * (100 - percent) // percent + 1)) for _ in range(2))
                b = np.union1d(a[gone:], choose.integers(0, 2**63, new).astype(np.uint64))
                both = len(np.intersect1d(a, b))
                if not len(b) or len(a) == len(b) == both or 100 * both < percent * (len(a) + len(b) - both):
                    continue
                linked += 1
                for share in (0, 0.3, 0.6, 1):
                    hot = np.sort(choose.choice(np.union1d(a, b), int(share * len(a)), replace=False))
                    assert len(np.intersect1d(ngram_join.segments(a, percent, bounds, hot), ngram_join.segments(b, percent, bounds, hot))), (percent, n)
            assert linked or n < 15


def test_segments_are_as_few_as_needed_and_no_shared_shingles():
    import numpy as np

    choose = np.random.default_rng(6)
    bounds, none = ngram_join.starts(80, 5000), np.empty(0, np.uint64)
    common = choose.integers(0, 2**63, 40).astype(np.uint64)
    sets = []
    for _ in range(300):  # unlike sets of 350 to 400, each with 6 of 40 common shingles
        own = choose.integers(0, 2**63, int(choose.integers(344, 395))).astype(np.uint64)
        sets.append(np.union1d(own, choose.choice(common, 6, replace=False)))
    keys = [ngram_join.segments(x, 80, bounds, none) for x in sets]
    for own, found in zip(sets, keys):
        assert len(found) <= 2 + 20 * (len(own) + len(own) * 100 // 80) // 180 + 20 * 2 * len(own) // 180
    listed, n = np.unique(np.concatenate(keys), return_counts=True)
    assert n[n > 1].sum() <= 10


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(1000, i) for i in range(1001, 1300)] + [(5000, 5001), (5001, 5000), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in range(2, 61)}, **{i: 1000 for i in range(1001, 1300)}, 5001: 5000}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# Personal data

BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def plain_spans(text):
    found = [(m.start(), k, m.end(), kind) for k, (kind, p, good) in enumerate(BASE) for m in re.finditer(p, text or "") if good(m.group())]
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found)]


def test_base_spans_equal_plain_matching(docs_of):
    choose = random.Random(8)
    bits = ["a.b@c.de", "@", "x@y", "a@b@c.d", "a@b.c+d@e.f", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "0001.002.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112",
            "+1 (523) 555-6688", "+12", "+4930123456789012", "🙂", "é", " ", "\n", "79927398713", "000000000000", "12345678901234567890", "+1..2..3", "..", "-", "%", "word", ",", "5500 0000 0000 0004"]
    rows = [(i, "".join(choose.choice(bits) + choose.choice(["", " ", ""]) for _ in range(choose.randint(1, 25)))) for i in range(400)]
    rows += [(900, None), (901, ""), (902, "1" * 20_000), (903, "a" * 20_000 + "@b.c"), (904, "1.2.3.4 " * 4000), (905, "x@y.z"), (905, "x@y.z"), (None, "q@r.st")]
    got = pii.per_document(pii.spans(docs_of(rows, extra=("kind", "start", "end", "row", "match")))).collect()
    assert len(got) == len(rows)
    want = {i: plain_spans(t) for i, t in rows}
    for r in got:
        spans = want[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest(), r.doc_id
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k + ":") for s in spans) for k, *_ in BASE]
        assert set(spans) <= set(r.spans.split(","))
    assert pii.per_document(pii.spans(docs_of([]))).count() == 0


def test_added_spans_are_learned_from_certain_ones(docs_of):
    choose = random.Random(6)
    secret = lambda: "".join(choose.choice("0123456789abcdef") for _ in range(40))
    rows = [(i, f"{prose(choose, 20)} token = \"{secret()}\" {prose(choose, 9)}") for i in range(300)]
    rows += [(1000 + i, prose(choose, 30) + f" {choose.randint(10**15, 10**16 - 1)} " + prose(choose, 5)) for i in range(300)]
    got = pii.per_document(pii.spans(docs_of(rows))).collect()
    assert sum("secret:" in r.spans for r in got if r.doc_id < 1000) >= 270
    assert all(set(filter(None, r.spans.split(","))) == set(plain_spans(dict(rows)[r.doc_id])) for r in got if r.doc_id >= 1000)
    assert F is not None


def test_disguised_addresses_and_cued_numbers_are_added(docs_of):
    choose = random.Random(7)
    digits = lambda n: "".join(choose.choice("123456789") for _ in range(n))
    said = {}
    for i in range(300):
        said[i] = "mail", f"{choose.choice(WORDS)} [at] example{i} [dot] com"
        said[1000 + i] = "number", digits(10)
    rows = [(i, prose(choose, 20) + (" phone: " if i >= 1000 else " ") + m + " " + prose(choose, 9)) for i, (_, m) in said.items()]
    rows += [(2000 + i, f"{prose(choose, 20)} ann{i}@example.com {prose(choose, 9)} +{digits(11)} {prose(choose, 5)}") for i in range(300)]
    rows += [(3000 + i, f"{prose(choose, 20)} {digits(10)} {prose(choose, 5)}") for i in range(300)]
    text = dict(rows)
    got = {r.doc_id: set(filter(None, r.spans.split(","))) for r in pii.per_document(pii.spans(docs_of(rows))).collect()}
    for low in (0, 1000):
        there = [f"{k}:{text[i].index(m)}:{text[i].index(m) + len(m)}" in got[i] for i, (k, m) in said.items() if low <= i < low + 1000]
        assert sum(there) >= 0.95 * len(there), low
    assert all(got[i] == set(plain_spans(t)) for i, t in rows if i >= 3000)
