"""Every operator against a brute-force version, and its defined results on odd inputs."""

from __future__ import annotations

import base64
import gzip
import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tessella.llm import jaccard, kernel, licenses, repeats, warc
from tessella.llm import secrets as sec
from tessella.llm.decontaminate import find_leaks
from tessella.llm.jaccard import jaccard_classes
from tessella.llm.licenses import scan_licenses
from tessella.llm.mixing import mix_sources
from tessella.llm.quality import quality_rules
from tessella.llm.repeats import find_repeats
from tessella.llm.secrets import scan_secrets
from tessella.llm.sharding import shard_documents
from tessella.llm.toxicity import fit_toxicity, score_toxicity

#: Names that operators use inside; clashing ones must not matter.
EXTRA = ["key", "sid", "uid", "n", "g", "place", "p", "toxic", "row", "shard", "size", "spans", "items", "kind", "id", "rank", "extra", "cell", "small", "path", "dir", "text_hash", "trusted", "words"]
SCHEMA = "doc_id long, text string, source string, " + ", ".join(f"{x} string" for x in EXTRA)
BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def low(s):
    return re.sub("[A-Z]", lambda m: m.group().lower(), s or "")


def words(s):
    return BLANK.findall(low(s))


def prose(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def edited(rng, text, share):
    return " ".join(w if rng.random() > share else f"e{rng.randrange(10**6)}" for w in text.split(" "))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    docs = [(None, "a null id but words enough to count here", "s1"), (1, None, "s1"), (2, "", None), (3, " \n\t ", "s2"), (4, prose(rng, 12_000, 5_000), "s0"), (5, "same row twice", "s2"), (5, "same row twice", "s2"), (6, "Ünïcode wörter, 日本語 İ ſ K x", "s3"), (7, "one", "s3"), (8, "ONE", "s3")]
    i = 100
    for _ in range(12):
        base = prose(rng, rng.randrange(20, 220), 10_000)
        for share in (0, 0, 0.01, 0.02, 0.04, 0.1):
            docs.append((i, edited(rng, base, share), f"s{i % 4}"))
            i += 1
    family = prose(rng, 120, 10_000)
    for _ in range(60):  # a family of near copies larger than any list kept as light
        docs.append((i, edited(rng, family, rng.choice([0.005, 0.01, 0.03])), "s0"))
        i += 1
    passage = prose(rng, 70, 10_000)
    for _ in range(40):  # a passage that many documents share, and nothing else
        docs.append((i, f"{prose(rng, 90, 10_000)} {passage} {prose(rng, 60, 10_000)}", "s0"))
        i += 1
    for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 12):  # small sets
        base = prose(rng, n + 4, 10_000).split()
        docs += [(i, " ".join(base), "s1"), (i + 1, " ".join(base[:-1]), "s1"), (i + 2, " ".join(base + ["more"]), "s1")]
        i += 3
    return docs


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame([(*d, *EXTRA) for d in corpus], SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, k=5):
    w = words(text)
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute_components(corpus):
    sets = [shingles(t) for _, t, _ in corpus]
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    low_id = {}
    for i, (doc, _, _) in enumerate(corpus):
        if doc is not None:
            low_id[root(i)] = min(low_id.get(root(i), doc), doc)
    return [(d, len(sets[i]), low_id.get(root(i)) if sets[i] else d) for i, (d, _, _) in enumerate(corpus)]


def order(rows):
    return sorted(rows, key=str)


def test_jaccard_matches_brute_force(docs, corpus):
    got = jaccard_classes(docs)
    assert order((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == order(brute_components(corpus))


@pytest.mark.parametrize("limits", [(2, 3), (10**6, 10**6), (4, 256)])
def test_jaccard_does_not_depend_on_what_is_heavy(docs, corpus, monkeypatch, limits):
    monkeypatch.setattr(jaccard, "HEAVY_FROM", limits[0])
    monkeypatch.setattr(jaccard, "LONGEST_LIST", limits[1])
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    got = jaccard_classes(docs)
    assert order((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == order(brute_components(corpus))


def test_boundary_follows_cost():
    assert jaccard.boundary({}, 3, 4) == 1
    assert jaccard.boundary({n: 10 for n in range(1, 64)}, 3, 4) > 4


def leak_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))


def test_leaks_match_brute_force(spark, docs, corpus):
    rng = random.Random(3)
    long_docs = [t for _, t, _ in corpus if t and len(t.split()) > 60]
    bench = [(i, " ".join(rng.choice(long_docs).split()[k : k + n])) for i, (k, n) in enumerate([(3, 10), (5, 25), (0, 9), (10, 4), (2, 1), (7, 40)] * 4)]
    bench += [(50, None), (51, ""), (52, "--"), (53, "ONE"), (53, "ONE"), (54, prose(rng, 30, 10**6)), (None, "same ROW, twice")]
    table = spark.createDataFrame([(*b, "x") for b in bench], "item_id long, text string, n string")
    got = {}
    for r in find_leaks(docs, table).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, sum(s.end - s.start for s in r.spans), ",".join(r["items"])))
    want = defaultdict(list)
    for d, t, _ in corpus:
        w, hit, items = leak_words(t), set(), set()
        for i, x in bench:
            b = leak_words(x)
            k = min(10, len(b))
            wins = {tuple(b[j : j + k]) for j in range(len(b) - k + 1)} if b else set()
            for p in range(len(w) - k + 1) if wins else ():
                if tuple(w[p : p + k]) in wins:
                    hit |= set(range(p, p + k))
                    items.add("null" if i is None else str(i))
        want[d].append((len(w), len(hit), ",".join(sorted(items))))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_leaks_by_shuffles_are_the_same(spark, docs):
    table = spark.createDataFrame([(r.doc_id, " ".join(r.text.split()[:30])) for r in docs.filter("doc_id > 100").limit(20).collect()], "item_id long, text string")
    rows = lambda **how: order((r.doc_id, r.n_words, str(r.spans), str(r["items"])) for r in find_leaks(docs, table, **how).collect())
    assert rows(most=0) == rows()
    assert find_leaks(docs, table.limit(0)).filter("size(spans) > 0").count() == 0


def test_repeats_find_every_shared_passage(docs, corpus):
    got = {r.doc_id: r for r in find_repeats(docs).collect()}
    seen = defaultdict(set)
    for d, t, _ in corpus:
        w = words(t)
        for i in range(len(w) - repeats.LEAST + 1):
            seen[tuple(w[i : i + repeats.LEAST])].add((d, t))
    for d, t, _ in corpus:
        w = words(t)
        hit = {p for i in range(len(w) - repeats.LEAST + 1) if len(seen[tuple(w[i : i + repeats.LEAST])]) > 1 for p in range(i, i + repeats.LEAST)}
        if d is None or d == 5:
            continue
        mine = {p for s in got[d].spans for p in range(s.start, s.stop)}
        assert got[d].n_words == len(w) and got[d].n_repeat_words == len(mine)
        assert len(hit - mine) <= 0.02 * len(hit) + 20 and len(mine - hit) <= 0.1 * len(mine) + 30, d
    shared = [got[d] for d, t, _ in corpus if d and d >= 232 and d < 272]
    assert all(r.n_repeat_words >= 70 and r.partners for r in shared)


def test_repeats_beside_boilerplate_are_exact_and_held_by_one_document(spark):
    rng = random.Random(29)
    rows = []
    for g in range(0, 900, 3):  # a and b share 50 to 60 words, of which c holds the first or last 36 to 49
        passage = prose(rng, 50 + g % 11, 10**6).split()
        part = passage[: 36 + g % 14] if g % 2 else passage[-36 - g % 14 :]
        rows += [(g + i, f"{prose(rng, 30, 10**6)} {' '.join(x)} {prose(rng, 30, 10**6)}") for i, x in enumerate((passage, passage, part))]
    both = [prose(rng, 60, 10**6) for _ in range(40)]  # two passages side by side, each from another document
    rows += [(1000 + i, x) for i, x in enumerate(both)] + [(2000 + i, f"{both[i]} {both[i + 1]}") for i in range(0, 40, 2)]
    split = {d: words(t) for d, t in rows}
    seen = defaultdict(set)
    for d, w in split.items():
        for i in range(len(w) - 49):
            seen[tuple(w[i : i + 50])].add(d)
    common = " ".join(["same"] * 40)  # one key that fills several partitions, in very many contexts
    for i in range(200):
        split[3000 + i] = words(f"{prose(rng, 20, 40)} {common} {prose(rng, 20, 40)}")
        rows.append((3000 + i, " ".join(split[3000 + i])))
        w = split[3000 + i]
        for j in range(len(w) - 49):
            seen[tuple(w[j : j + 50])].add(3000 + i)
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        got = find_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for r in got:
        w = split[r.doc_id]
        hit = {p for i in range(len(w) - 49) if len(seen[tuple(w[i : i + 50])]) > 1 for p in range(i, i + 50)}
        assert {p for s in r.spans for p in range(s.start, s.stop)} == hit and r.n_repeat_words == len(hit), r.doc_id
        for s in r.spans:
            assert any(f" {' '.join(w[s.start : s.stop])} " in f" {' '.join(split[p])} " for p in r.partners), r.doc_id


def test_one_passage_in_very_many_documents_is_found_across_partitions(spark):
    rng = random.Random(1)
    passage = prose(rng, 60, 10**6)
    rows = [(i, f"{prose(rng, 20, 10**6)} {passage} {prose(rng, 20, 10**6)}" if i % 3 == 0 else prose(rng, 100, 10**6)) for i in range(600)]
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = {r.doc_id: r.n_repeat_words for r in find_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert all((n >= 60) == (i % 3 == 0) and (n == 0) == (i % 3 != 0) for i, n in got.items())


def brute_base(text):
    out = []
    for kind, p, group, least, flags in (("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, re.I | re.A), ("access", r"AKIA[A-Z0-9]+", 0, 20, 0), ("hex", r"[0-9a-f]+", 0, 24, 0)):
        out += [(m.start(), ("assign", "access", "hex").index(kind), m.end()) for m in re.finditer(p, text, flags) if len(m.group(group)) >= least]
    return sorted(out)


SECRETS = [
    'password = "hunter2hunter2"', "PASSWD:abc", "token:'abcdef' secret=xyz12345", "AKIA" + "A" * 15, "AKIA" + "A" * 16 + " AKIAAKIA", "f" * 23, "0" * 24 + "g" + "1" * 30, 'DB = "s3cr3t-Value-99"\nconn.password = DB\n',
    "api_key=abcdef apikey = 'zz'", "ſecret=abcdefgh toKen=abcdefgh", 'db_pwd: "Zx9!qwerty" # note', 'export AWS_SECRET_ACCESS_KEY=wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY', "😀 password=abcdef123", "a == b := c => d = ", "x='" + "a" * 5000,
]


def test_secret_base_matches_the_patterns():
    rng = random.Random(5)
    pieces = ["password", "Token", "=", ":", " ", '"', "'", "abcdef0123456789", "AKIA", "ABCDEF0123456789", "secret", "api_key", "\n", "é", "f" * 12]
    for text in SECRETS + ["".join(rng.choice(pieces) for _ in range(40)) for _ in range(400)]:
        got = [(s, sec.KINDS.index(k), e) for k, s, e in sec.find_secrets(text) if k in ("assign", "access", "hex")]
        assert got == brute_base(text), text


def test_secret_lexing_adds_names_and_propagation():
    kinds = lambda t: {(k, t[s:e]) for k, s, e in sec.find_secrets(t)}
    assert ("flow", "s3cr3t-Value-99") in kinds(SECRETS[7])
    assert ("named", "Zx9!qwerty") in kinds(SECRETS[10])
    assert ("flow", "abc-123") in kinds('A = "abc-123"\nB = "DEF-456"\nclient_secret = A + B')
    assert not kinds("color: bright red\ncount = 12345678")
    assert sec.score("password", "changeme") == 0 and sec.name_weight("dbPassword") == 3 and sec.name_weight("width") == 0


def test_scan_secrets_rows(spark, docs, nothing, corpus):
    assert scan_secrets(docs).count() == len(corpus) and scan_secrets(nothing).count() == 0
    rows = spark.createDataFrame([(1, None), (None, SECRETS[0])], "doc_id long, text string")
    assert {r.doc_id: len(r.spans) for r in scan_secrets(rows).collect()} == {1: 0, None: 2}


def test_quality_measures_match_brute_force(spark, docs, nothing, corpus):
    noisy = [(9001, "a b c\na b c\n\n \na b c\n#$ %& <x> |*", "s"), (9002, "x y z x y z x", "s"), (9003, "dup\ndup \ndup\n\n", "s"), (9004, "one two", "s")]
    every = docs.select("doc_id", "text").unionAll(spark.createDataFrame([(d, t) for d, t, _ in noisy], "doc_id long, text string"))
    trusted = spark.createDataFrame([(i,) for i in range(100, 130)] + [(None,)], "doc_id long")
    got = defaultdict(list)
    for r in quality_rules(every, trusted).collect():
        got[r.doc_id].append((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed))
        assert r.kept == (not r.base_failed and r.score >= -0.15)
    for d, t, _ in [*corpus, *noisy]:
        t = t or ""
        w = BLANK.findall(t)
        tri = defaultdict(list)
        for i in range(len(w) - 2):
            tri[tuple(w[i : i + 3])].append(i)
        rep = {p for at in tri.values() if len(at) > 1 for i in at for p in range(i, i + 3)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if BLANK.search(line):
                dup += line in seen
                seen.add(line)
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(rep), len(w) < 50 or 100 * len(rep) > 50 * len(w))
        assert want in got[d], d
    assert quality_rules(nothing, trusted).count() == 0
    assert {r.score for r in quality_rules(docs, trusted.limit(0)).select("score").distinct().collect()} == {0.0}


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(900):
        toxic, junk = i % 9 == 0, i % 7 == 0
        text = prose(rng, rng.randrange(5, 200)) + (" dreadful" if toxic else "") + (" zzz###" if junk else "") + " " + prose(rng, 30)
        rows.append((i, text))
        if i < 600:
            labels.append((i, 0 if junk else 1, int(toxic)))
    docs = spark.createDataFrame([*rows, (None, None), (5000, "")], "doc_id long, text string")
    labelled = spark.createDataFrame([*labels, (None, 1, 1), (77777, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    cats = {"junk": "quality = 0", "toxic": "toxic = 1"}
    chain = fit_toxicity(docs, labelled, cats)
    got = {r.doc_id: r for r in score_toxicity(docs, chain).collect()}
    held = range(600, 900)
    assert sum(got[i].toxic == (i % 9 == 0) for i in held) >= 297
    assert not got[None].toxic and not got[5000].toxic and len(got) == 902
    again = fit_toxicity(docs.repartition(7), labelled.repartition(3), cats)
    assert again.cuts == chain.cuts
    assert not any(r.toxic for r in score_toxicity(docs, fit_toxicity(docs, labelled.limit(0), cats)).collect())


def crc(t):
    return zlib.crc32((t or "").encode())


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_sharding_law(docs, corpus, shards):
    rows = shard_documents(docs, shards).collect()
    assert order((r.doc_id, r.size, r.text_crc32) for r in rows) == order((d, len((t or "").encode()) + 16, crc(t)) for d, t, _ in corpus)
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    counts = [len(by[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())


def test_sharding_keeps_groups_and_splits_hot_ones(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"pair {i // 6}" if i % 3 == 1 else f"alone {i}") for i in range(1200)]
    got = shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 20).collect()
    where = defaultdict(set)
    for r in got:
        where[r.group].add(r.shard)
    several = sum(len(s) > 1 for s in where.values())
    assert max(map(len, where.values())) <= 9 and several <= 0.1 * len(where)


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, out, free = sum(sizes.values()), {}, set(names)
    left = total
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 3 * sizes[s]}
        if not over:
            return out | {s: weight[s] * level for s in free}
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        free -= over
    return out


def test_mixing_meets_targets(docs, corpus):
    rows = mix_sources(docs).collect()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for d, t, s in corpus:
        sizes[s] += len(BLANK.findall(t or ""))
    for r in rows:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3 and r.source_size == sizes[r.source]
    want = brute_targets(dict(sizes))
    for s in sizes:
        assert target[s] == pytest.approx(want[s], abs=1e-6)
        assert abs(taken[s] - want[s]) <= max(0.05 * want[s], 200), s
    assert order((r.doc_id, r.size, r.taken) for r in rows) == order((r.doc_id, r.size, r.taken) for r in mix_sources(docs.repartition(3)).collect())


def test_warc_round_trip_and_salvage(spark, tmp_path):
    html = ["<p>a</p>", None, "", "é\r\nWARC/1.1\r\nWARC-Type: fake\r\n\r\n日本", "<p>a</p>", "x" * 100_000, "<p>a</p>"]
    pages = spark.createDataFrame([(i * 3, f"http://h/{i}\n x" if i else None, t, "z") for i, t in enumerate(html)], "page_id long, url string, html string, first string")
    path = str(tmp_path / "w")
    warc.write_warc(pages, "file://" + path)
    rows = {r.record_id: r for r in warc.read_warc(spark, "file://" + path, True).collect()}
    for i, t in enumerate(html):
        raw = (t or "").encode()
        first = min(j for j, u in enumerate(html) if (u or "") == (t or ""))
        r = rows[f"<urn:x-page:{i * 3}>"]
        assert r.payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode() and r.payload_bytes == len(raw)
        assert (r.warc_type, r.refers_to) == (("response", None) if first == i else ("revisit", f"<urn:x-page:{first * 3}>"))
        assert first != i or bytes(r.payload) == raw
    warc.write_warc(pages.limit(0), "file://" + path + "0")
    assert warc.read_warc(spark, "file://" + path + "0").count() == 0


def test_salvage_recovers_later_records():
    parts = [warc.record(i, f"http://h/{i}", f"<p>{i}</p>".encode() * 50, None) for i in range(6)]
    good = lambda found: [x.headers["warc-record-id"][12:-1] for x in found if x.headers]
    gaps = lambda found: [(x.start, x.end) for x in found if x.headers is None]
    plain = b"".join(parts)
    assert good(warc.salvage(plain)) == list("012345") and not gaps(warc.salvage(plain))
    cut = len(parts[0]) + 40
    torn = plain[:cut] + plain[cut + 30 :]
    found = list(warc.salvage(torn))
    assert good(found) == list("02345") and gaps(found) == [(len(parts[0]), len(parts[0]) + len(parts[1]) - 30)]
    flipped = plain.replace(b"<p>3</p>", b"<p>X</p>", 1)
    assert good(warc.salvage(flipped)) == list("01245") and any("digest" in x.reason for x in warc.salvage(flipped))
    assert good(warc.salvage(b"noise\n" + plain[:-10])) == list("01234")
    members = [gzip.compress(p, mtime=0) for p in parts]
    whole = b"".join(members)
    assert good(warc.salvage(whole)) == list("012345")
    at = len(members[0]) + 20
    broken = bytearray(whole)
    broken[at : at + 8] = b"\xff" * 8
    found = list(warc.salvage(bytes(broken)))
    assert good(found) == list("02345") and gaps(found) == [(len(members[0]), len(members[0]) + len(members[1]))]
    assert list(warc.salvage(b"")) == [] and gaps(warc.salvage(b"junk")) == [(0, 4)]


def test_licenses_and_inheritance(spark, nothing):
    rows = [
        ("a/LICENSE", licenses.TEMPLATES["MIT"][0]), ("a/b/c/x.py", "print(1)"), ("a/y.py", "# Licensed under the Apache License, Version 2.0.\nprint(2)"), ("z.py", "plain"), ("a/b/LICENSE", "Released under the ISC License."),
        ("a/b/n", None), (None, "none"), (None, "Released under the MIT License."), ("d/e", "The licence to drive was lost."), ("a/q", ""),
    ]
    df = spark.createDataFrame([(i, *r, "k") for i, r in enumerate(rows)], "doc_id long, p string, text string, dir string")
    got = {r.doc_id: (r.license, r.inherited_from) for r in scan_licenses(df, df["p"]).collect()}
    assert got == {0: ("MIT", None), 1: ("ISC", "a/b"), 2: ("Apache-2.0", None), 3: (None, None), 4: ("ISC", None), 5: ("ISC", "a/b"), 6: (None, None), 7: ("MIT", None), 8: (None, None), 9: ("MIT", "a")}
    assert scan_licenses(nothing, nothing["path"]).count() == 0


@pytest.mark.parametrize("name, text", [(n, t) for n, ts in licenses.TEMPLATES.items() for t in ts])
def test_every_template_is_its_own_best(name, text):
    assert licenses.detect("head\n" + text, licenses.Templates())[0] == name


@pytest.mark.parametrize("run", [jaccard_classes, find_repeats, mix_sources, shard_documents])
def test_empty_tables(nothing, run):
    assert run(nothing).count() == 0


def test_kernel_agrees_with_python_words():
    import pyarrow as pa

    rng = random.Random(2)
    texts = ["".join(rng.choice(["a", "B", " ", "\n", "\x0b", "é", "\x00", "日", " ", "-"]) for _ in range(rng.randrange(30))) for _ in range(300)] + [None, ""]
    data, offs = kernel.buffers(pa.array(texts))
    seen = {}
    for lo, hi, d, o in kernel.slices(data, offs, 64):
        for table, split in ((kernel.BLANKS, words), (kernel.NON_ALNUM, leak_words)):
            w = kernel.Words(d, o, table)
            for i in range(hi - lo):
                mine = w.hash[w.first[i] : w.first[i + 1]]
                want = split(texts[lo + i])
                assert len(mine) == len(want)
                for h, x in zip(mine.tolist(), want, strict=True):
                    assert seen.setdefault(x, h) == h
    assert len(set(seen.values())) == len(seen)
    assert np.array_equal(kernel.mix(np.zeros(1, np.uint64)), np.zeros(1, np.uint64))
