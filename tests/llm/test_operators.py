"""Each operator on odd rows (nulls, empty and long texts, repeats, ties, clashing columns, no rows) against brute force."""

import base64
import gzip
import hashlib
import math
import os
import random
import re
import string
import struct
import unicodedata
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessellate.llm import (
    exact_dedup, language_id, mixing, packing, pii, quality_classifier, quality_rules, simhash, token_counts, warc,
)
from tessellate.llm.graph import components

WORDS = "the of and lumen taro vex quil sorb mint dray pelt".split()
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, fp string, kept boolean, topic string, component_id long"


def texts():
    rnd = random.Random(11)
    base = [" ".join(rnd.choices(WORDS, k=rnd.randint(1, 60))) for _ in range(40)]
    near = [b.replace("taro", "tarn", 1) for b in base[:12]]
    odd = [None, "", " \n\t ", "Ünïcode ÉTÉ straße", "A a A a", "a A a a", "x" * 5000, "word " * 4000, "line\nline\n\nline\n", base[0].upper(), base[0], base[0]]
    odd += ["mail bob.x+1@ex-am.ple.org now, 10.0.0.255 or 10.0.0.256 4111 1111 1111 1111 +1 (415) 555-0100", "#$%&*|<>", "日本語のテキスト", "Привет мир"]
    return base + near + odd


@pytest.fixture(scope="module")
def docs(spark):
    """Rows with clashing extra columns, a null id and a repeated row."""
    rows = [(i, t, ("en", "de", None)[i % 3], ("big", "big", "small", None)[i % 4], 0, -1, "x", None, "t", 5) for i, t in enumerate(texts())]
    rows += [rows[3], (None, "no id at all", "en", "big", 0, 0, "", None, None, 0), (3, "another text of id three", "en", "big", 0, 0, "", None, None, 0)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def clashing(spark):
    """The same with a column for each name that the operators use within, and a map."""
    source = "".join(p.read_text() for p in Path(exact_dedup.__file__).parent.glob("*.py"))
    names = sorted(set(re.findall(r"""["'](_[a-z]+(?:_[a-z]+)*)["']""", source)) | {"_of_source", "_of_lang", "_of_topic", "row", "n", "u", "v", "a.b"})
    assert {"_id", "_key", "_n", "_p", "_of", "_y", "_row", "_gone", "_topic", "_text"} <= set(names)
    rows = [(i, t, ("en", "de", None)[i % 3], ("big", "small", None)[i % 3]) for i, t in enumerate(texts())] + [(None, "no id at all", "en", "big"), (3, "a text", "en", "big")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    more = [F.concat(F.lit(f"{n}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("x"))).alias(n) for n in names]
    return df.select("*", *more, F.create_map(F.lit("k"), F.col("doc_id")).alias("a_map")).repartition(3)


def whole(df):
    return Counter(str(r) for r in df.collect())


def test_stages_return_all_columns_as_they_are(clashing):
    rows = whole(clashing)
    stages = [
        exact_dedup.keep_exact, simhash.keep_one, language_id.keep_identified, mixing.sample, lambda d: mixing.sample(d, copies=True),
        lambda d: mixing.sample(d, topic=F.col("_topic")),
    ]
    for stage in stages:
        out = stage(clashing)
        assert out.columns == clashing.columns
        got = whole(out)
        assert got and set(got) <= set(rows)
    labels = clashing.select("doc_id", (F.col("doc_id") % 2).alias("quality"))
    weights = quality_classifier.train(clashing, labels)
    n = sum(rows.values())
    others = [
        quality_classifier.classify(clashing, weights), exact_dedup.exact_dedup(clashing), simhash.simhash_groups(clashing), mixing.mix(clashing),
        quality_rules.quality_rules(clashing), language_id.learn_and_identify(clashing), pii.find_pii(clashing),
    ]
    assert all(x.count() == n for x in others) and packing.pack(clashing, WORD_BPE).count() >= n


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_no_rows(none):
    assert exact_dedup.exact_dedup(none).count() == exact_dedup.keep_exact(none).count() == 0
    assert simhash.simhash_groups(none).count() == simhash.keep_one(none).count() == 0
    assert mixing.mix(none).count() == mixing.sample(none).count() == 0
    assert quality_rules.quality_rules(none).count() == 0 and pii.find_pii(none).count() == 0
    assert packing.pack(none, WORD_BPE).count() == 0
    assert language_id.learn_and_identify(none).count() == language_id.keep_identified(none).count() == 0
    weights = quality_classifier.train(none, none.select("doc_id", F.lit(1).alias("quality")))
    assert not weights.any() and quality_classifier.classify(none, weights).count() == 0
    assert token_counts.token_counts(none, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0


# ---- exact dedup


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_exact_dedup(docs):
    groups = defaultdict(list)
    for i, t in pairs(docs):
        groups[lowered(t)].append(i)
    want = sorted(
        (str(i), max((x for x in g if x is not None), default=None), len(g), i == max((x for x in g if x is not None), default=None), hashlib.sha256(t.encode()).hexdigest())
        for t, g in groups.items() for i in g
    )
    got = sorted((str(r.doc_id), r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(docs, salts=3).collect())
    assert got == want
    kept = [(r.doc_id, lowered(r.text)) for r in exact_dedup.keep_exact(docs).collect()]
    assert len(kept) == len(set(kept)) == len(groups) and exact_dedup.keep_exact(docs).columns == docs.columns


def test_exact_dedup_compares_texts_and_not_digests_alone(spark, monkeypatch):
    df = spark.createDataFrame([(1, "aa"), (2, "bb")], "doc_id long, text string")
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, bits: F.lpad(F.length(c).cast("string"), 64, "0"))
    with pytest.raises(Exception, match="share a digest"):
        exact_dedup.exact_dedup(df).collect()


# ---- SimHash


def slow_print(t):
    words = (t or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reach(nodes, linked):
    label = {n: n for n in nodes}
    while True:
        before = dict(label)
        for a, b in linked:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            return label


def test_simhash_groups(docs):
    rows = [(i, slow_print(t)) for i, t in pairs(docs)]
    named = [(i, p) for i, p in rows if i is not None]
    linked = [(i, j) for i, p in named for j, q in named if (p ^ q).bit_count() <= 4]
    label = reach({i for i, _ in named}, linked)
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.simhash_groups(docs).collect())
    of_print = {p: label[i] for i, p in named}
    assert got == sorted((str(i), f"{p:016x}", label[i] if i is not None else of_print.get(p)) for i, p in rows)
    assert len(set(label.values())) < len(label)


def test_an_id_of_several_texts_links_them(spark):
    a, b = " ".join(WORDS), " ".join(reversed(WORDS))
    df = spark.createDataFrame([(3, a), (5, a), (5, b), (9, b), (9, None), (8, "lone word"), (None, b)], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in simhash.simhash_groups(df).collect()}
    assert got == {(3, 3), (5, 3), (9, 3), (8, 8), (None, 3)}


@pytest.mark.parametrize("k", [2, 4, 7])
def test_block_pairs_are_few_and_lose_nothing(spark, k):
    """All pairs of blocks that hold linked leaves within the budgets stay; of the others, most go."""
    rnd = random.Random(k)
    prefix = min(simhash.ring(k))
    low = 64 - prefix
    keys = sorted({rnd.choice([0, 1, 5]) << low | rnd.getrandbits(10) << low - 10 | rnd.getrandbits(6) for _ in range(900)})
    rows, blocks = [], {}
    for rot in range(k + 1):
        for node in sorted({x >> 64 - prefix for x in keys}):
            own = [x for x in keys if x >> 64 - prefix == node]
            for i in range(0, len(own), 4):
                blocks[rot, own[i]] = own[i : i + 4]
                rows += [(rot, node, int(np.uint64(own[i]).view(np.int64)), int(np.uint64(x).view(np.int64)), x % 1000) for x in own[i : i + 4]]
    df = spark.createDataFrame(rows, "rot int, node long, block long, key long, id long")
    got = {(r.rot, int(np.int64(r.a).view(np.uint64)), int(np.int64(r.b).view(np.uint64))) for r in simhash.block_pairs(df, k).collect()}
    got = {(r, *sorted(x)) for r, *x in got}
    every = {(r, a, b) for r, a in blocks for q, b in blocks if q == r and a < b and a >> 64 - prefix == b >> 64 - prefix}
    need = set()
    for r, a, b in every:
        budget = simhash.budgets(k, r).tolist()
        if any(all((x ^ y) >> 64 - d << 64 - d and ((x ^ y) >> 64 - d).bit_count() <= budget[d] or not (x ^ y) >> 64 - d for d in range(1, 65)) for x in blocks[r, a] for y in blocks[r, b]):
            need.add((r, a, b))
    assert need <= got <= every and (len(got) < 0.5 * len(every) or len(every) < 10)


@pytest.mark.parametrize("k, block", [(4, 2048), (4, 8), (0, 8), (7, 16)])
def test_trie_join_finds_every_link(spark, monkeypatch, k, block):
    rnd = random.Random(k)
    centres = [rnd.getrandbits(64) for _ in range(30)]
    prints = {c ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 9))) for c in centres for _ in range(20)} | {0, 2**64 - 1, 1 << 63}
    ids = {p: i for i, p in enumerate(sorted(prints))}
    df = spark.createDataFrame([(i, int(np.uint64(p).view(np.int64))) for p, i in ids.items()], "id long, fp long")
    monkeypatch.setattr(simhash, "block_size", lambda n: block)
    got = [(r.u, r.v) for r in simhash.links(df, k).collect()]
    want = [(ids[p], ids[q]) for p in prints for q in prints if p < q and (p ^ q).bit_count() <= k]
    assert reach(ids.values(), got) == reach(ids.values(), want)


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 2000), (2000, 3000)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 301)} | {2000: 1000, 3000: 1000}


# ---- mixing


def test_mixing_meets_marginals_and_both_paths_agree(docs):
    few = {r.doc_id: r for r in mixing.mix(docs, rate=0.4, sweeps=3).collect() if r.doc_id is not None and r.doc_id != 3}
    many = {r.doc_id: r for r in mixing.mix(docs, rate=0.4, sweeps=3, most_cells=1).collect() if r.doc_id is not None and r.doc_id != 3}
    assert few.keys() == many.keys() and len(few) == len(texts()) - 1
    assert all(few[i].weight == pytest.approx(many[i].weight, abs=2e-5) and few[i].p == pytest.approx(many[i].p, abs=2e-5) for i in few)
    rows = mixing.mix(docs, rate=0.4).collect()
    total = sum(r.n_tokens for r in rows)
    assert sum(r.n_tokens * r.p for r in rows) == pytest.approx(0.4 * total, rel=1e-3)
    seen, raked = Counter(), Counter()
    for r in rows:
        seen[r.topic] += r.n_tokens
        raked[r.topic] += r.n_tokens * r.weight
    norm = sum((v / total) ** mixing.ALPHA for v in seen.values())
    # The dimension fitted last is met exactly.
    assert all(raked[k] / total == pytest.approx((v / total) ** mixing.ALPHA / norm, abs=1e-4) for k, v in seen.items())
    kept = Counter((r.doc_id, r.text) for r in mixing.sample(docs, rate=0.4).collect())
    assert sum(kept.values()) == sum(r.sampled for r in rows)


def test_given_targets(docs):
    rows = mixing.mix(docs, targets={"topic": {"note": 0.9}}, sweeps=30).collect()
    total = sum(r.n_tokens for r in rows)
    assert sum(r.n_tokens * r.weight for r in rows if r.topic == "note") / total > 0.4


def test_expected_copies_meet_rate_and_marginals(docs):
    rows, shown = mixing.mix(docs, copies=True).collect(), mixing.shares(docs).collect()
    total = sum(r.n_tokens for r in rows)
    assert sum(r.n_tokens * r.expected for r in rows) == pytest.approx(mixing.RATE * total, rel=1e-4) and max(r.expected for r in rows) > 1
    for dim in mixing.DIMS:
        seen, got = Counter(), Counter()
        for r in rows:
            seen[r[dim]] += r.n_tokens
            got[r[dim]] += r.n_tokens * r.expected
        norm = sum((v / total) ** mixing.ALPHA for v in seen.values())
        raked = {r.value: r.raked for r in shown if r.dim == dim}
        assert raked == pytest.approx({k: v / mixing.RATE / total for k, v in got.items()}, abs=1e-4)
        if dim == "topic":  # the one fitted last is met exactly, the others as far as the sweeps come on these few rows
            assert raked == pytest.approx({k: (v / total) ** mixing.ALPHA / norm for k, v in seen.items()}, abs=1e-4)
            assert any(abs(r.under_p - r.raked) > 0.01 for r in shown if r.dim == dim)
        under = {r.value: r.under_copies for r in shown if r.dim == dim}
        assert all(under[k] == pytest.approx(v / mixing.RATE / total, abs=1e-4) for k, v in got.items())
    kept = Counter((r.doc_id, r.text) for r in mixing.sample(docs, copies=True).collect())
    assert sum(kept.values()) == sum(r.copies for r in rows) and all(abs(r.copies - r.expected) < 1 for r in rows)
    few, many = ({(r.doc_id, r.n_tokens): r.expected for r in mixing.mix(docs, copies=True, sweeps=1, most_cells=n).collect()} for n in (mixing.CELLS, 1))
    assert few == pytest.approx(many, abs=2e-5)


# ---- quality rules


def test_quality_rules(docs):
    def slow(t):
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        n = Counter(grams)
        covered = {i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(8)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))

    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.quality_rules(docs).collect())
    assert got == sorted((str(i), *(c := slow(t)), c[0] < 20 or 100 * c[4] > 30 * c[0]) for i, t in pairs(docs))


def test_a_bad_host_goes_and_small_ones_are_shrunk(spark):
    good, bad = " ".join(f"w{i}" for i in range(40)), "### $$$ " * 30
    rows = [(i, bad if i < 45 else good, "bad") for i in range(50)] + [(100 + i, good, f"host{i % 5}") for i in range(200)] + [(999, good, "new")]
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not got[49].kept and got[100].kept and got[999].kept and 0 < got[999].host_rate < 0.5


# ---- token counts


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts(docs, rule):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True

    def sections(raw: bytes):
        cuts = [m.end() for m in re.finditer(rb"[.!?,]|\n\n", raw) if m.end() < len(raw)]
        return np.array([0, *cuts], np.int64)

    rows = token_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, rule=rule, sections=sections).collect()
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: (str(r.doc_id), r.section)):
        got[r.doc_id].append((r.start, r.length, r.n_tokens, r.doc_tokens))
    for i, t in pairs(docs):
        if i == 3 or not (t or "").isascii():
            continue
        t = t or ""
        starts = [0, *[m.end() for m in re.finditer(r"[.!?,]|\n\n", t) if m.end() < len(t)]]
        counts, e = Counter(), tok.encode(t, add_special_tokens=False)
        for a, b in e.offsets:
            inside = [sum(1 for x in range(a, b) if s <= x < n) for s, n in zip(starts, [*starts[1:], len(t)])]
            own = [k for k, v in enumerate(inside) if v]
            counts[{"first": own[0], "last": own[-1], "most": max(own, key=lambda k: inside[k])}[rule]] += 1
        assert got[i] == [(s, n - s, counts[k], len(e.ids)) for k, (s, n) in enumerate(zip(starts, [*starts[1:], len(t)]))]


# ---- quality classifier


def test_classifier_learns_and_scores_everything(spark, docs):
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choice(WORDS) + ("***" if i % 2 else "") for _ in range(30)), 1 - i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    labels = df.select("doc_id", "quality").union(spark.createDataFrame([(None, 1), (7, None)], "doc_id long, quality int"))
    weights = quality_classifier.train(df.filter("doc_id < 200"), labels)
    got = {r.doc_id: r for r in quality_classifier.classify(df, weights).collect()}
    held = range(200, 300)
    assert sum((got[i].score >= 0.5) == (i % 2 == 0) for i in held) >= 99
    odd = quality_classifier.classify(docs, weights).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in odd)
    at, x = quality_classifier.sparse(rows[0][1])
    direct = 1 / (1 + np.exp(-(weights[at].astype(float) @ x + weights[-1])))
    assert got[0].score == pytest.approx(direct, abs=1e-5)


def slow_quality(rows, epochs=quality_classifier.EPOCHS):
    """(scores of texts, by follow-the-regularised-leader over plain dictionaries) for rows (order, text, label or None)."""
    m64 = (1 << 64) - 1

    def mixed(x, salt):
        x = (x + salt) * 0x9E3779B97F4A7C15 & m64
        return ((x ^ x >> 29) * 0xBF58476D1CE4E5B9 & m64) >> 46

    def values(t):
        words = (t or "").encode().split()
        h = [quality_classifier.word_hashes(w) for w in words]
        a, b, m = [x for x, _ in h], [y for _, y in h], 0x100000001B3
        pair = [(x * m + y) & m64 for x, y in zip(b, b[1:])]
        streams = [
            [mixed(len(words).bit_length(), 1)], [mixed(x, 2) for x in a], [mixed(x * m + y & m64, 3) for x, y in zip(a, a[1:])],
            [mixed(int(x == y), 4) for x, y in zip(a, a[1:])], [mixed(x, 5) for x in b], [mixed(x, 6) for x in pair],
            [mixed(x * m + y & m64, 7) for x, y in zip(pair, b[2:])],
        ]
        out = Counter()
        for s in streams:
            for x in s:
                out[x] += quality_classifier.SCALE / len(s)
        return out

    q = quality_classifier
    z, n = defaultdict(float), defaultdict(float)
    w = lambda i: 0.0 if abs(z[i]) <= q.L1 else (math.copysign(q.L1, z[i]) - z[i]) / ((q.BETA + math.sqrt(n[i])) / q.ALPHA + q.L2)
    seen = {t: values(t) for _, t, _ in rows}
    for _ in range(epochs):
        for _, t, y in sorted((r for r in rows if r[2] is not None), key=lambda r: r[0]):
            x = {**{k: np.float32(v).item() for k, v in seen[t].items()}, "bias": 1.0}
            own = {i: w(i) for i in x}
            p = 1 / (1 + math.exp(-max(-35, min(35, sum(own[i] * v for i, v in x.items())))))
            for i, v in x.items():
                g = (p - y) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / q.ALPHA * own[i]
                n[i] += g * g
    return [1 / (1 + math.exp(-max(-35, min(35, w("bias") + sum(w(i) * v for i, v in seen[t].items()))))) for _, t, _ in rows]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_quality_query_equals_a_slow_version(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    order = lambda i: np.uint64(xxhash.xxh64_intdigest(struct.pack("<q", i), 42)).view(np.int64).item()
    rows = [(order(i), t, None if held(i) else labels.get(i)) for i, t in docs.items()]
    want = dict(zip(docs, slow_quality(rows)))
    got = {r.doc_id: r for r in quality_classifier.op6_quality_classifier(spark, DATA).collect()}
    assert got.keys() == docs.keys()
    assert all(got[i].held_out == held(i) and got[i].score == pytest.approx(want[i], abs=1e-3) and got[i].predicted == int(got[i].score >= 0.3) for i in got)


# ---- WARC


def test_warc_round_trip(spark, tmp_path, monkeypatch):
    big = "".join(random.Random(1).choices("abcdefgh", k=200_000))
    rows = [(1, "http://a", "same"), (5, "http://b", "same"), (0, None, None), (7, "u", ""), (9, "http://c", big), (9, "http://c", big), (None, "x", "lone"), (4, "s p", "é" * 40), (2, "http://d", "\r\n\r\n" * 5)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, record_type int")
    folder = str(tmp_path / "w")
    warc.write_warc(pages, folder)
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in warc.read_warc(spark, folder, payloads=True).collect())
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h in rows:
        body = (h or "").encode()
        at = first.get(h or "", i)
        revisit = at != i
        want.append((str(i), len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", at if revisit else None, None if revisit else body))
    assert got == sorted(want)
    files = [p.read_bytes() for p in Path(folder).glob("part-*")]
    assert sum(gzip.decompress(f).count(b"WARC/1.1\r\n") for f in files) == len(rows)
    assert len(files) < len(rows)
    monkeypatch.setattr(warc, "STREAMED", ())
    assert warc.read_warc(spark, folder, payloads=True).count() == len(rows)
    warc.write_warc(pages.repartition(1), folder, archive_bytes=1)
    assert len(list(Path(folder).glob("part-*"))) == len(rows) == warc.read_warc(spark, folder).count()
    warc.write_warc(pages, folder, least_bytes=100)
    assert warc.read_warc(spark, folder).filter("record_type = 'revisit'").count() == 0
    warc.write_warc(pages.limit(0), folder)
    assert warc.read_warc(spark, folder).count() == 0


def test_a_large_archive_is_read_in_little_memory(tmp_path):
    """100 MB of archive, of records that don't compress, are read from the file with a few of them held at a time."""
    import tracemalloc

    body, path = random.Random(2).randbytes(1 << 20), tmp_path / "x y.warc.gz"
    one = warc.record(1, "u", body, None, False)
    with open(path, "wb") as f:
        for _ in range(100):
            f.write(one)
    tracemalloc.start()
    with warc.opened(path.as_uri()) as file:
        assert sum(warc.parse(m)["payload_bytes"] for m in warc.members(file)) == 100 << 20
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 20 << 20


def test_warc_reader_refuses_damage():
    good = warc.record(1, "u", b"payload", None, False)
    assert [warc.parse(m)["payload"] for m in warc.members(good + good)] == [b"payload"] * 2
    with pytest.raises(warc.BadRecord):
        list(warc.members(good[:-5]))
    inner = bytearray(gzip.decompress(good))
    for damaged in (inner.replace(b"payload", b"paylaod"), inner[:-3], inner.replace(b"Content-Length: 8", b"Content-Length: 9", 1)):
        if damaged != inner:
            with pytest.raises(warc.BadRecord):
                warc.parse(damaged)


def test_a_record_of_16_mb_still_ends_in_zero():
    body = bytes(17 << 20)
    made = warc.record(1, "u", body, None, False)
    assert made[-1] == 0 and [len(m) > 0 for m in warc.members(made)].count(True) == 1


# ---- language identification


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n, k = rng.integers(1, 40), rng.integers(1, 5)
        s = -rng.random((n, k)) * 4
        s -= s.max(axis=1, keepdims=True)
        best = np.zeros(k)
        for row in s:
            best = np.maximum(best, best.max() - 3.0) + row
        path = language_id.viterbi(s, 3.0)
        assert s[np.arange(n), path].sum() - 3.0 * (np.diff(path) != 0).sum() == pytest.approx(best.max())


def test_languages_spans_and_odd_texts(spark, docs):
    rnd = random.Random(2)
    vocab = {"aa": ["tholen", "marish", "thend", "ingoth"], "bb": ["queñas", "osción", "larrios", "ueza"], "ru": ["привет", "мирный", "слова"]}
    say = lambda lang, n: " ".join(rnd.choices(vocab[lang], k=n))
    rows = [(i, say(lang, 30), lang) for i in range(60) for lang in vocab]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "text", "lang", "doc_id")
    mixed = say("aa", 20) + "\n" + say("bb", 12)
    test = spark.createDataFrame([(1, mixed), (2, say("ru", 3)), (3, None), (4, "12 ** 9"), (5, "日本語"), (6, "THOLEN Marish!"), (None, "x")], "doc_id long, text string")
    got = {r.doc_id: r for r in language_id.identify(test, model).collect()}
    cut = mixed.index("\n") + 1
    assert got[1].spans == f"aa:0:{cut},bb:{cut}:{len(mixed)}" and got[1].lang_pred == "aa" and 0.5 < got[1].lang_share < 1
    assert got[2].lang_pred == "ru" and got[6].lang_pred == "aa" and got[3].lang_pred == got[4].lang_pred == "und"
    assert got[5].lang_pred in vocab and got[5].score == 0
    assert language_id.identify(docs, model).count() == docs.count()
    small = language_id.Words(model)
    assert (small.rows(mixed.encode().split())[0] == language_id.Words(model).rows(mixed.encode().split())[0]).all()


def test_a_corpus_of_one_language_stays(spark):
    rows = [(i, f"tholen marish thend {i}", "aa") for i in range(40)] + [(50, "日本語", None), (51, "12 ** 9", None)]
    one = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id for r in language_id.keep_identified(one).collect()} == set(range(40))
    got = {r.doc_id: r for r in language_id.learn_and_identify(one).collect()}
    assert all(got[i].lang_pred == "aa" and got[i].lang_share == 1 and got[i].score > 0.5 for i in range(40))
    assert got[50].score == got[50].lang_share == 0 and got[51].lang_pred == "und"


def slow_language(rows, learn):
    """lang_pred and score of each text by plain dictionaries and a plain dynamic program, for latin letters alone."""
    def grams_of(w):
        m = 0xFFFFFFFF
        x = [2, *map(ord, w), 3]
        return [((a * 0x9E3779B1 & m) ^ (b * 0x85EBCA77 & m) ^ (c * 0xC2B2AE3D & m)) >> 16 for a, b, c in zip(x, x[1:], x[2:])] + [zlib.crc32(w.encode()) >> 16]

    def words_of(t):
        return [x for w in re.findall(r"[^\x20\x09-\x0D]+", t or "") if (x := "".join(filter(str.isalpha, w)).lower())]

    counts = defaultdict(Counter)
    for i, t, lang in rows:
        if lang is not None and learn(i):
            for w in words_of(t):
                counts[lang].update(grams_of(w))
    langs, used = sorted(counts), len(set().union(*counts.values()))
    total = {x: sum(counts[x].values()) for x in langs}
    logs = {x: defaultdict(lambda x=x: math.log(0.1 / (total[x] + 0.1 * used)), {b: math.log((n + 0.1) / (total[x] + 0.1 * used)) for b, n in counts[x].items()}) for x in langs}
    known, out = {}, {}
    for i, t, _ in rows:
        words = words_of(t)
        if not words:
            out[i] = "und", 0.0
            continue
        for w in set(words) - known.keys():
            raw = [sum(logs[x][b] for b in grams_of(w)) for x in langs]
            known[w] = [max(v - max(raw), language_id.FLOOR) for v in raw]
        value, came = [0.0] * len(langs), []
        for w in words:
            top = max(range(len(langs)), key=value.__getitem__)
            came.append([j if v >= value[top] - language_id.SWITCH else top for j, v in enumerate(value)])
            value = [max(v, value[top] - language_id.SWITCH) + s for v, s in zip(value, known[w])]
        at, path = max(range(len(langs)), key=value.__getitem__), []
        for step in reversed(came):
            path.append(at)
            at = step[at]
        by = Counter()
        for j, w in zip(reversed(path), words):
            by[j] += len(w)
        pred = max(sorted(by), key=by.__getitem__)
        sums = [sum(known[w][j] for p, w in zip(reversed(path), words) if p == pred) for j in range(len(langs))]
        margin = sums[pred] - max(v for j, v in enumerate(sums) if j != pred)
        out[i] = langs[pred], by[pred] / sum(map(len, words)) * (1 - math.exp(-max(margin, 0.0) / -language_id.FLOOR))
    return out


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_language_query_equals_a_slow_version(spark):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    learn = lambda i: zlib.crc32(str(i).encode()) % 4 != 2
    want = slow_language(rows, learn)
    got = {r.doc_id: r for r in language_id.op8_language_id(spark, DATA).collect()}
    assert got.keys() == want.keys() and all(got[i].held_out != learn(i) for i in got)
    assert all(got[i].lang_pred == want[i][0] and got[i].score == pytest.approx(want[i][1], abs=1e-3) for i in got)


def test_many_languages_and_a_small_cache(spark, monkeypatch):
    say = lambda k: " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{x}" for x in ("qor", "zel", "mun"))
    rows = [(k * 2 + j, say(k), f"l{k:04d}") for k in range(300) for j in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(language_id, "BYTES_HELD", 4 * 300 * 20)
    monkeypatch.setattr(language_id, "MOST_BROADCAST", 10)
    model = language_id.fit(df, "text", "lang", "doc_id")
    words = language_id.Words(model)
    assert len(model.langs) == 300 and words.most == 20
    assert all(language_id.label(t, words)[0] == lang for _, t, lang in rows)


# ---- packing


def test_packing(docs):
    tok = Tokenizer.from_file(WORD_BPE)
    got = defaultdict(list)
    rows = packing.pack(docs, WORD_BPE, capacity=64, salts=3).collect()
    for r in rows:
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    want = defaultdict(list)
    for i, t in pairs(docs):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want[i] += [(k // 64, k, len(ids[k : k + 64]), zlib.crc32(ids[k : k + 64].tobytes())) for k in range(0, len(ids), 64)]
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for items in by.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 64


def fewest(sizes, capacity):
    """The fewest bins, by search."""
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for r in sorted(set(rooms)):
            if r >= sizes[i]:
                left = list(rooms)
                left[left.index(r)] -= sizes[i]
                go(i + 1, left)
        go(i + 1, [*rooms, capacity - sizes[i]])

    go(0, [])
    return best[0]


def test_reduction_never_costs_a_bin():
    rnd = random.Random(4)
    for _ in range(150):
        sizes = [rnd.randint(1, 20) for _ in range(rnd.randint(1, 9))]
        stock = packing.Stock(Counter(sizes))
        fixed = packing.reduce_dominated(stock, 20)
        left = list(stock.n.elements())
        assert sum(times for _, times in fixed) + (fewest(left, 20) if left else 0) == fewest(sizes, 20)
        assert sorted(left + [x for p, times in fixed for x, n in p for _ in range(n * times)]) == sorted(sizes)
        assert all(sum(x * n for x, n in p) <= 20 for p, _ in fixed)


def test_plan_places_every_rank_once():
    rnd = random.Random(9)
    counts = Counter(rnd.randint(1, 100) for _ in range(5000))
    steps = packing.plan(counts, 100)
    length = np.repeat(list(counts), list(counts.values()))
    rank = np.concatenate([np.arange(n) for n in counts.values()])
    sequence, offset = packing.place(steps, length, rank)
    bins = defaultdict(list)
    for s, o, n in zip(sequence, offset, length):
        bins[s].append((o, n))
    assert all([o for o, _ in sorted(b)] == list(np.cumsum([0] + [n for _, n in sorted(b)])[:-1]) for b in bins.values())
    assert len(bins) <= 1.01 * -(-length.sum() // 100) + 1


@pytest.mark.parametrize("seed", range(3))
def test_word_ids_equal_the_whole_tokenizer(seed):
    rnd, tok, known = random.Random(seed), Tokenizer.from_file(WORD_BPE), packing.word_ids(WORD_BPE)
    signs = list("abcXYZ'''.,!*<>|é ÉßŒİıſK 12\n\t́Σςσ日本😀") + ["<|endoftext|>", "<|ENDOFTEXT|>", "'s", "it's", "'LL"]
    for _ in range(3000):
        text = "".join(rnd.choice(signs) for _ in range(rnd.randint(0, 14)))
        assert np.frombuffer(known.of(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, text


def test_word_ids_of_composing_letters():
    """Every pair of an ASCII letter and a character that it composes with, in words of either case and with a mark between."""
    tok, known, rnd = Tokenizer.from_file(WORD_BPE), packing.word_ids(WORD_BPE), random.Random(3)
    pairs_ = [a + c for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x20000))) for a in string.ascii_letters if not unicodedata.normalize("NFC", a + c).startswith(a)]
    assert {c for _, c in pairs_} <= set(map(chr, range(0x300, 0x370))) and len(pairs_) > 200
    marks = [chr(c) for c in range(0x300, 0x370)]
    composed = [chr(c) for c in range(0xC0, 0x250)] + [chr(c) for c in range(0x1E00, 0x1F00)] + ["\u212a", "\u212b"]
    cases = [f"{x}{p}{y} Some" for p in pairs_ for x, y in (("", ""), ("Ab", "aD."))] + [p[0] + rnd.choice(marks) + p[1] for p in pairs_] + composed
    cases += ["".join(rnd.choice([*marks, *"ABYTHWJabç É.'1", *composed]) for _ in range(9)) for _ in range(3000)]
    for text in cases:
        assert np.frombuffer(known.of(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, ascii(text)


def test_other_tokenizers_encode_whole_texts(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, known = Tokenizer.from_file(path), packing.word_ids(path)
    assert packing.word_ids(WORD_BPE).by_word and not known.by_word
    for text in ("Some  Text, it's\n\nÉté 42", "", None):
        assert np.frombuffer(known.of(text), "<u4").tolist() == tok.encode(text or "", add_special_tokens=False).ids


# ---- personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum((d := int(c)) if i % 2 == 0 else 2 * d - 9 * (d > 4) if (d := int(c)) or True else 0 for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(t):
    out = []
    for rank, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, t or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")) or kind == "card" and 14 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 10 <= len(digits) <= 15:
                out.append((m.start(), rank, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_base_spans(spark, docs):
    rnd = random.Random(6)
    signs = list("ab1234567890@@..--  ()+é_\n😀") + ["4111 1111 1111 1111", "+1 (415) 555-0100", "a.b@c.de", "10.0.0.1", "a@b.c"]
    rows = [(i, "".join(rnd.choice(signs) for _ in range(rnd.choice([3, 20, 60, 300])))) for i in range(1000)] + [(9001, "a" * 100000), (9002, "1" * 50001), (9003, "x@y.z " * 20000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    got = Counter((r.doc_id, r.base_spans) for r in pii.find_pii(df).collect())
    assert got == Counter((i, base_spans(t)) for i, t in pairs(df))


def with_luhn(digits):
    return next(digits + c for c in "0123456789" if luhn(digits + c))


def planted(rnd, n):
    """(texts, the span of the loosely written datum in each that has one, texts with a decoy): a third each, beside exact data."""
    words = "the of and look home patterns lumen taro vex quil we met noon".split()
    say = lambda k: " ".join(rnd.choices(words, k=k))
    texts_, want, decoys = {}, {}, set()
    for i in range(n):
        a, b, c = rnd.randint(100, 999), rnd.randint(100, 999), rnd.randint(1000, 9999)
        name, domain = rnd.choice(["jane", "bob.k", "x_y"]) + str(a), f"mail{rnd.randint(1, 9)}.example.{rnd.choice(['com', 'org', 'de'])}"
        parts = [str(rnd.randint(1, 255)) for _ in range(4)]
        card = with_luhn("".join(rnd.choices("0123456789", k=15)))
        bad = card[:-1] + str((int(card[-1]) + rnd.randint(1, 9)) % 10)
        by4 = lambda d, mark: mark.join(d[k : k + 4] for k in (0, 4, 8, 12))
        kind = rnd.choice(list(PATTERNS))
        exact = {"email": f"{name}@{domain}", "ip": ".".join(parts), "card": by4(card, rnd.choice(["", " ", "-"])), "phone": f"+1 ({a}) {b}-{c}"}
        loose = {
            "email": [f"{name} (at) {domain.replace('.', ' (dot) ')}", f"{name} at {domain.replace('.', ' dot ')}", f"{name}[at]{domain}", f"{name} @ {domain}"],
            "ip": ["[.]".join(parts), " . ".join(parts), " dot ".join(parts)],
            "card": [by4(card, "."), by4(card, "/"), by4(card, "_"), by4(card, " - ")],
            "phone": [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+1/{a}/{b}/{c}"],
        }
        wrong = {
            "email": [f"{name} (at) {domain.rsplit('.', 1)[0]}.7", "look at polka dot patterns"],
            "ip": ["[.]".join(["999", *parts[1:]]), f"{parts[0]}[.]{parts[1]}[.]{parts[2]}"],
            "card": [by4(bad, "."), by4(bad, "/"), by4(bad, " - ")],
            "phone": [f"order id {a}-{b}-{c}", f"PN-{a}-{b}-{c}", f"{a}-{b}-{c}-77", f"serial no. {a} {b} {c}", f"2024-03-{a % 28}"],
        }
        before = (say(rnd.randint(1, 20)) + " ") * (rnd.random() < 0.9)
        value = [exact[kind], rnd.choice(loose[kind]), rnd.choice(wrong[kind])][i % 3]
        texts_[i] = before + value + rnd.choice(["", ". " + say(3), ", " + say(3), " " + say(4)])
        if i % 3 == 1:
            want[i] = f"{kind}:{len(before)}:{len(before) + len(value)}"
        elif i % 3 == 2:
            decoys.add(i)
    return texts_, want, decoys


@pytest.mark.parametrize("exact", [True, False])
def test_loose_data_are_added_and_decoys_are_not(spark, exact):
    """Also without a base span in all the texts, where own examples alone are learned from."""
    texts_, want, decoys = planted(random.Random(8), 1500)
    rows = [(i, t) for i, t in texts_.items() if exact or i % 3]
    got = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        base, spans = (list(filter(None, x.split(","))) for x in (got[i].base_spans, got[i].spans))
        assert got[i].base_spans == base_spans(t) and set(base) <= set(spans) and len(spans) == len(base) + got[i].added
        places = sorted((int(a), int(b)) for s in set(spans) - set(base) for _, a, b in [s.split(":")])
        assert all(b <= c for (_, b), (c, _) in zip(places, places[1:]))
        assert not any(a < int(d) and int(c) < b for a, b in places for _, c, d in (s.split(":") for s in base))
    added, hit = sum(r.added for r in got.values()), sum(x in got[i].spans.split(",") for i, x in want.items())
    assert added > 0 and hit >= 0.9 * len(want) and hit >= 0.95 * added
    assert sum(got[i].added for i in decoys) <= 0.02 * len(decoys)


def test_spans_that_meet(spark):
    """``meet`` against all pairs, over random spans that overlap, nest and repeat."""
    rnd = random.Random(12)
    x = dict.fromkeys(pii.FEATURES, 1)
    span = lambda: (k := rnd.choice(pii.KINDS), a := rnd.randint(0, 60), a + rnd.randint(1, 9))
    rows = [(i, i, sorted({span() for _ in range(rnd.randint(0, 6))}), [(*span(), None, x | {"checksum": rnd.randint(0, 1)}) for _ in range(rnd.randint(0, 6))]) for i in range(300)]
    plain = "kind: string, start: long, end: long"
    df = spark.createDataFrame(rows, f"_row long, _id long, base array<struct<{plain}>>, candidates array<struct<{plain}, right: int, x: struct<{pii.VECTOR}>>>")
    got = {(r._row, r.kind, r.start, r.end, r.x.checksum): (r.free, r.wrong) for r in pii.meet(df).collect()}
    want = {}
    for i, _, base, candidates in rows:
        for k, a, b, _, f in candidates:
            met = {kind for kind, c, d in base if a < d and c < b}
            want[i, k, a, b, f["checksum"]] = not met, k not in met and (bool(met) or f["checksum"] == 0)
    assert got == want


def test_threshold_and_choice(spark):
    assert pii.threshold([(3.0, 50, 0), (2.0, 49, 1), (-2.0, 0, 9)], 0.98) == 0.0 and pii.threshold([(3.0, 50, 0), (2.0, 1, 9)], 0.98) == 2.5
    assert pii.threshold([(1.0, 0, 4)], 0.98) == float("inf") == pii.threshold([], 0.98)
    trees = pii.Trees([((d, 0, 0, 0, 0, 0, 0), float(d > 4), float(d <= 4)) for d in range(10)])
    x = lambda d: dict.fromkeys(pii.FEATURES, 0) | {"digits": d}
    rows = [(1, "ip", 0, 5, x(9), True), (1, "ip", 4, 9, x(9), True), (1, "ip", 8, 12, x(9), True), (1, "ip", 20, 22, x(1), True), (2, "ip", 0, 3, x(9), False), (2, "email", 0, 3, x(9), True)]
    df = spark.createDataFrame(rows, f"_row long, kind string, start long, end long, x struct<{pii.VECTOR}>, free boolean")
    got = {r._row: sorted((s.start, s.end) for s in r.more) for r in pii._chosen(df, {"ip": (trees, 0.0)}).collect()}
    assert got == {1: [(0, 5), (8, 12)]}


def test_trees_fit_a_table():
    rows = [((a, b, 0, 0, 0, 0, 0), 9.0 * (a > 2), 9.0 * (a <= 2)) for a in range(5) for b in range(3)]
    trees = pii.Trees(rows)
    assert min(trees.score(x) for x, r, _ in rows if r) > 1 > -1 > max(trees.score(x) for x, r, _ in rows if not r)
