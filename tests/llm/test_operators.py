"""Each operator against brute force, on small and on awkward inputs."""

from __future__ import annotations

import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from accretio.llm import bm25, bm25_index, line_dedup, minhash_dedup, packing, pii, quality_classifier, quality_rules, token_counts, tokens, url_filters
from accretio.llm.bpe import Encoder, Utf8Machine, read_ranks
from accretio.llm.common import NULL_ID
from accretio.llm.components import components
from accretio.llm.config_lp import pack
from accretio.llm.cuckoo import CuckooFilter

SF = "/root/testdata/sf0.001"
WORDS = "the of and to in is that for it was on are as with his they at be this from have or by one had not but what all were when we there can an".split()


def prose(rng: random.Random, n: int) -> str:
    out = [rng.choice(WORDS) + str(rng.randrange(40)) * (rng.random() < 0.5) for _ in range(n)]
    return " ".join(w + ("\n" if rng.random() < 0.05 else "") for w in out)


def awkward(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, columns with clashing names."""
    rng = random.Random(5)
    long = prose(rng, 20_000)
    line = "This line is found in very many documents here."
    base = prose(rng, 120)
    rows = [(1, base), (2, base), (3, base + " more"), (3, base + " more"), (4, ""), (5, None), (None, base), (None, None), (6, long), (7, "x"), (8, "a b c d"), (9, "a b c d"),
            (10, line + "\n" + prose(rng, 60)), (11, "  " + line.upper() + "\t\nother"), (12, line), (13, "\n\n" + line), (14, "mail me@here.org or +1 (017) 555-7713, 10.0.0.1")]
    schema = "doc_id long, text string, n_words string, kept string, base string, drop string, verdict string, rule string, node long, bands string, __words string, ids string"
    return spark.createDataFrame([(d, t, "w", None, "b", None, "v", "r", 1, "x", "y", "z") for d, t in rows], schema)


def documents(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet")


def empty(docs):
    return docs.limit(0)


# 7, 2: tokens ------------------------------------------------------------------
@pytest.fixture(scope="module")
def reference():
    ranks = read_ranks(P.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_transducer_equals_library(reference):
    rng, coder = random.Random(1), Encoder(P.path("byte_bpe_50k.tiktoken"))
    pieces = ["a", "b", "é", "ß", "日", "本", " ", "  ", "\n", "😀", "1", "²", "_", ".", "the", "ing", "'s", "\u00a0", "\u2003", "\x1c", "\x85", "er"]
    for _ in range(1500):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 60)))
        ids = np.frombuffer(coder.packed_ids(text), "<u4").tolist()
        assert ids == reference.encode_ordinary(text)
        assert "".join(coder.decode_stream(ids, 3)) == text
    for text in ("a" * 30_000, "é" * 5000, " " * 5000, "ab" * 10_000):
        assert np.frombuffer(coder.packed_ids(text), "<u4").tolist() == reference.encode_ordinary(text)


def test_utf8_machine_in_any_pieces():
    data = "aé日😀z".encode() + b"\xff\xc3" + "é".encode()
    for size in range(1, 6):
        machine = Utf8Machine()
        got = "".join(machine.feed(data[i : i + size]) for i in range(0, len(data), size)) + machine.end()
        assert got == data.decode("utf-8", "replace")


def test_round_trip_rows(spark, reference):
    docs = documents(spark).select("doc_id", "text").union(awkward(spark).select("doc_id", "text"))
    want = Counter()
    for r in docs.collect():
        ids = reference.encode_ordinary(r["text"] or "")
        want[r["doc_id"], len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256((r["text"] or "").encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in tokens.round_trip(docs).collect()) == want
    assert tokens.round_trip(empty(docs)).count() == 0
    back = tokens.decoded(tokens.encoded(awkward(spark)).drop("text"))
    assert Counter((r["doc_id"], r["text"]) for r in back.collect()) == Counter((r["doc_id"], r["text"] or "") for r in awkward(spark).collect())


def test_token_counts(spark):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    docs = documents(spark).select("text").union(awkward(spark).select("text"))
    lengths = [len(library.encode(r["text"] or "", add_special_tokens=False).ids) for r in docs.collect()]
    hist = token_counts.histogram(docs)
    answered = token_counts.answers(hist)
    got = {r["length"]: r for r in answered.collect()}
    assert set(got) == set(lengths)
    for limit, r in got.items():
        assert r["docs_within"] == sum(x <= limit for x in lengths)
        assert r["truncated_total"] == sum(min(x, limit) for x in lengths)
        assert r["tokens_total"] == sum(lengths)
    for r in token_counts.truncated_totals(answered, [0, 7, 512, 10**6, -1]).collect():
        assert r["truncated_total"] == sum(min(x, max(r["context"], 0)) for x in lengths)
    for r in token_counts.quantile_lengths(answered, [0.1, 0.5, 1.0]).collect():
        assert r["length"] == sorted(lengths)[math.ceil(r["share"] * len(lengths)) - 1]
    assert token_counts.answers(token_counts.histogram(empty(docs))).count() == 0


# 3: packing ----------------------------------------------------------------------
def test_pack_holds_every_item_once():
    rng = np.random.default_rng(3)
    for count in (np.bincount(rng.integers(1, 101, 5000), minlength=101), np.bincount([60] * 999 + [41] * 500, minlength=101), np.zeros(101, int), np.bincount([100] * 7 + [1], minlength=101)):
        plan, used = pack(count, 100), np.zeros(101, int)
        for config, times in plan.items():
            assert sum(length * n for length, n in config) <= 100
            for length, n in config:
                used[length] += n * times
        assert (used[1:] == count[1:]).all()
    count = np.bincount(rng.integers(1, 101, 200_000), minlength=101)
    assert sum(pack(count, 100).values()) <= 1.01 * (count * np.arange(101)).sum() / 100


@pytest.mark.parametrize("size", [1024, 50])
def test_packing_rows(spark, size):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    docs = documents(spark).select("doc_id", "text").union(awkward(spark).select("doc_id", "text"))
    rows = packing.packed(docs, size).collect()
    own = defaultdict(list)
    for r in docs.collect():
        ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        first, at = len(ids) % size or size, 0
        for piece, upto in enumerate(range(first, len(ids) + 1, size)):
            own[r["doc_id"], piece, at, upto - at, zlib.crc32(ids[at:upto].tobytes())].append(1)
            at = upto
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == Counter({k: len(v) for k, v in own.items()})
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    total = sum(r["length"] for r in rows)
    assert len(bins) <= 1.05 * total / size + 2
    assert packing.packed(empty(docs), size).count() == 0


# 4: lines ----------------------------------------------------------------------------
def cleaned_by_hand(rows):
    holders = defaultdict(set)
    split = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        keys = [re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r")) for x in lines]
        split.append((doc, lines, keys))
        for k in keys:
            if len(k) >= 20:
                holders[k].add(NULL_ID if doc is None else doc)
    out = Counter()
    for doc, lines, keys in split:
        own = NULL_ID if doc is None else doc
        kept = [x for x, k in zip(lines, keys) if not (len(holders[k]) >= 3 and max(holders[k]) != own)]
        out[doc, len(lines), len(lines) - len(kept), sha256("\n".join(kept).encode()).hexdigest()] += 1
    return out


def digest_rows(df):
    return Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in df.collect())


def test_lines(spark):
    odd = [(100 + i, "ÀÉÎ äöü ñ ligne répétée\n\u00a0À not stripped by us ok \n" + "x" * 19 + "\n" + "y" * 20) for i in range(4)]
    docs = documents(spark).select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string")).union(awkward(spark).select("doc_id", "text"))
    assert digest_rows(line_dedup.deduplicated(docs)) == cleaned_by_hand([tuple(r) for r in docs.collect()])
    assert line_dedup.deduplicated(empty(docs)).count() == 0
    assert set(line_dedup.deduplicated(awkward(spark)).columns) >= set(awkward(spark).columns)


def test_lines_of_large_shards(spark, monkeypatch):
    """Shards dealt over many tasks, and shards put anew as the index grows, give the same rows."""
    docs = documents(spark).select("doc_id", "text").union(awkward(spark).select("doc_id", "text"))
    want = cleaned_by_hand([tuple(r) for r in docs.collect()])
    monkeypatch.setattr(line_dedup, "TOGETHER", 20)
    assert digest_rows(line_dedup.deduplicated(docs)) == want
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 1)
    first = docs.where("doc_id % 9 = 0")
    index = line_dedup.LineIndex.build(first)
    grown = index.insert(docs)
    assert grown.shards > index.shards
    assert digest_rows(grown.cleaned(docs)) == want


def test_cuckoo_filter_of_one_shard():
    rng = np.random.default_rng(7)
    h = rng.integers(-(2**63), 2**63 - 1, (400_000, 2), dtype=np.int64)
    h = h[(h[:, 0].view(np.uint64) >> np.uint64(40)) % np.uint64(16) == 3][:20_000]
    f = CuckooFilter(len(h))
    f.insert(h[:, 0].copy(), h[:, 1].copy())
    assert len(f.stash) < 5 and f.contains(h[:, 0].copy(), h[:, 1].copy()).all()


def test_lines_insert_then_delete_is_as_never_inserted(spark):
    docs = documents(spark).select("doc_id", "text")
    first, second = docs.where("doc_id % 3 <> 0"), docs.where("doc_id % 3 = 0")
    index = line_dedup.LineIndex.build(first)
    both = index.insert(second)
    assert digest_rows(both.cleaned(docs)) == cleaned_by_hand([tuple(r) for r in docs.collect()])
    back = both.delete(second.select("doc_id"))
    assert digest_rows(back.cleaned(first)) == cleaned_by_hand([tuple(r) for r in first.collect()])


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    h = rng.integers(-(2**63), 2**63 - 1, (20_000, 2), dtype=np.int64)
    f = CuckooFilter(1000)
    for part in np.split(h, 20):
        f.insert(part[:, 0].copy(), part[:, 1].copy())
    f = CuckooFilter.from_bytes(f.to_bytes())
    assert f.contains(h[:, 0].copy(), h[:, 1].copy()).all()
    other = rng.integers(-(2**63), 2**63 - 1, (20_000, 2), dtype=np.int64)
    assert f.contains(other[:, 0].copy(), other[:, 1].copy()).mean() < 0.02
    f.delete(h[:10_000, 0].copy(), h[:10_000, 1].copy())
    assert f.contains(h[10_000:, 0].copy(), h[10_000:, 1].copy()).all()
    assert f.contains(h[:10_000, 0].copy(), h[:10_000, 1].copy()).mean() < 0.02


# 5: urls -----------------------------------------------------------------------------------
def url_by_hand(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in url_filters.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(r.text)) if fits else None


def test_urls(spark):
    odd = [None, "", "nope", "://", "http://", "HTTP://WWW.Example.ORG/es/1?x=/a#b", "http://org/", "http://xorg/", "http://a.org?x=1/2", "x://y://z.org/en/1", "http://example.org/en/12", "http://a.com/de/é", "http://a.com/de/\nx", "h" * 5000 + "://a.com/fr/" + "z" * 50_000]
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").union(spark.createDataFrame([(1000 + i, u) for i, u in enumerate(odd * 2)], "page_id long, url string"))
    pages = pages.withColumn("host", pages.page_id).withColumn("verdict", pages.url)
    rows = url_filters.judged(pages).collect()
    assert len(rows) == pages.count()
    by_hand = [(r["page_id"], r["url"]) for r in pages.collect()]
    want = Counter((p, *(lambda h: (h[0], h[1], h[2].text if h[2] else None))(url_by_hand(u))) for p, u in by_hand)
    assert Counter((r["page_id"], r["host"], r["path"], r["rule"]) for r in rows) == want
    for r in rows:
        fit = url_by_hand(r["url"])[2]
        assert r["verdict"] == fit.verdict if fit else r["verdict"] in ("allow", "block")
        if not r["host"] and fit is None:
            assert r["verdict"] == "allow"
    assert url_filters.judged(empty(pages)).count() == 0


def test_mined_rules_by_hand(spark):
    """A label that two tokens imply together, and neither alone."""
    labelled = [(f"http://s{i % 2}.x{i % 3}.net/{'ad' if i % 3 == 0 else 'ok'}/{i}", "block" if i % 2 == 0 and i % 3 == 0 else "allow") for i in range(300)]
    got = url_filters.judged(spark.createDataFrame([(1, "http://s0.x0.net/ad/7"), (2, "http://s1.x0.net/ad/7"), (3, "http://s0.x1.net/ok/7")], "page_id long, url string"), [], spark.createDataFrame(labelled, "url string, label string"))
    assert {r["page_id"]: r["verdict"] for r in got.collect()} == {1: "block", 2: "allow", 3: "allow"}


def tokens_by_hand(url):
    """(slot tokens, further tokens) of a url."""
    host, path, _ = url_by_hand(url)
    if not host:
        return [], []
    labels, parts = host.split(".")[::-1], [x for x in re.sub("[0-9]+", "#", path).split("/") if x]
    query = url.split("?", 1)[1].split("#")[0].split("&") if "?" in url else [""]
    keys = [q.split("=")[0] for q in query]
    slots = {"scheme": url.split("://")[0].lower(), "tld": labels[0], "domain": ".".join(labels[1::-1]) if len(labels) > 1 else None,
             "sub1": labels[2] if len(labels) > 2 else None, "sub2": labels[3] if len(labels) > 3 else None, "dir1": parts[0] if parts else None,
             "dir2": parts[1] if len(parts) > 2 else None, "leaf": parts[-1] if len(parts) > 1 else None,
             "ext": parts[-1].rsplit(".", 1)[1] if parts and "." in parts[-1] else None, "query": keys[0] or None}
    more = [f"more-sub:{x}" for x in labels[4:]] + [f"more-dir:{x}" for x in parts[2:-1]] + [f"more-query:{x}" for x in keys[1:] if x]
    return [f"{k}:{v}" for k, v in slots.items() if v is not None], sorted(set(more))


def verdicts_by_hand(urls, labelled):
    """Counts every token set, and lets the best rule that fits decide."""
    sets, with_label, n = Counter(), Counter(), len(labelled)
    for url, label in labelled:
        slots, more = tokens_by_hand(url)
        for take in range(1 << len(slots)):
            some = [t for i, t in enumerate(slots) if take >> i & 1]
            for one in [[], *[[x] for x in more]]:
                if some or one:
                    sets[tuple(sorted(some + one))] += 1
                    with_label[tuple(sorted(some + one)), label] += 1
    rules = [(c / sets[s], c / n, label, list(s)) for (s, label), c in with_label.items() if c >= url_filters.SUPPORT * n and c / sets[s] >= url_filters.CONFIDENCE]
    out = []
    for url in urls:
        own = {t for side in tokens_by_hand(url) for t in side}
        fits = [r for r in rules if own.issuperset(r[3])]
        out.append((max(fits)[2], max(fits)[0]) if fits else ("allow", None))
    return out


def test_mined_rules_by_counting_all_sets(spark):
    rng = random.Random(11)

    def url():
        host = ".".join([*rng.sample(["a", "b", "c", "d", "e"], rng.randint(0, 4)), rng.choice(["shop", "news"]), rng.choice(["net", "io"])])
        path = "".join(f"/{rng.choice(['x', 'y', 'p1', 'p2', 'z.html'])}" for _ in range(rng.randint(0, 6)))
        keys = "&".join(f"{rng.choice('quv')}={rng.randrange(9)}" for _ in range(rng.randint(0, 3)))
        return f"http://{host}{path}" + (f"?{keys}" if keys else "")

    def label(u):
        slots, more = tokens_by_hand(u)
        bad = "more-dir:y" in more and "tld:net" in slots or "more-sub:a" in more or "more-query:v" in more and rng.random() < 0.9 or "dir1:x" in slots and "sub1:c" in slots
        return "block" if bad else "allow"

    labelled = [(u, label(u)) for u in (url() for _ in range(400))]
    urls = [url() for _ in range(150)] + ["http://a.b.c.d.e.news.io/q/w/y/y/e?q=1&v=2&v=3", "", "no url"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    got = {r["page_id"]: (r["verdict"], r["confidence"]) for r in url_filters.judged(pages, [], spark.createDataFrame(labelled, "url string, label string")).collect()}
    assert [got[i] for i in range(len(urls))] == verdicts_by_hand(urls, labelled)
    assert any(v == "block" for v, _ in got.values())


def test_mined_rules_with_a_part_beyond_the_slots(spark):
    """Only a fourth path segment, a sixth host label or a second key tells the label."""
    def labelled(bad, good):
        return spark.createDataFrame([(bad if i % 4 == 0 else good, "block" if i % 4 == 0 else "allow") for i in range(200)], "url string, label string")

    for bad, good in (("http://x.net/a/b/c/ads/e/f", "http://x.net/a/b/c/d/e/f"), ("http://ads.a.b.c.x.net/", "http://d.a.b.c.x.net/"), ("http://x.net/?a=1&ads=2", "http://x.net/?a=1&b=2")):
        pages = spark.createDataFrame([(1, bad), (2, good)], "page_id long, url string")
        assert {r["page_id"]: r["verdict"] for r in url_filters.judged(pages, [], labelled(bad, good)).collect()} == {1: "block", 2: "allow"}


# 6: quality rules -----------------------------------------------------------------------------
def stats_by_hand(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    marked = {j for i in range(len(words) - 2) if windows[words[i], words[i + 1], words[i + 2]] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked)


def test_quality_rules(spark):
    odd = ["a b c " * 3, "a b c a b c", "x\u00a0y z", "#*$%&|<>", "l\nl\n \n \nl", "a b c d a b c e b c d", "w " * 5000]
    docs = documents(spark).select("doc_id", "text").union(spark.createDataFrame([(900 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")).union(awkward(spark).select("doc_id", "text"))
    rows = quality_rules.judged(docs.withColumn("n_words", docs.text).withColumn("kept", docs.text)).collect()
    assert len(rows) == docs.count()
    for r in rows:
        want = stats_by_hand(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["kept"] and r["base_failed"])
    assert quality_rules.judged(empty(docs)).count() == 0
    assert quality_rules.judged(docs).where("kept").count() == sum(r["kept"] for r in rows)


def test_cascade_order_changes_nothing(spark):
    docs = documents(spark).select("doc_id", "text")
    one = {r["doc_id"]: r["kept"] for r in quality_rules.judged(docs, quality_rules.method_rules()).collect()}
    two = {r["doc_id"]: r["kept"] for r in quality_rules.judged(docs, quality_rules.method_rules()[::-1]).collect()}
    assert one == two


# 8: near duplicates --------------------------------------------------------------------------------
def shingles(text):
    words = (text or "").lower().split()
    k = min(5, len(words))
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else Counter()


def classes_by_hand(rows):
    ids = [NULL_ID if d is None else d for d, _ in rows]
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [shingles(t) for _, t in rows]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    for pair in {(a, b) for h in holders.values() for n, a in enumerate(h) for b in h[n + 1 :]}:
        a, b = sets[pair[0]], sets[pair[1]]
        both, either = sum((a & b).values()), sum((a | b).values())
        if both >= 0.8 * either:
            x, y = find(ids[pair[0]]), find(ids[pair[1]])
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("small", [16, 2])
def test_near_duplicates(spark, monkeypatch, small):
    """small 2 and tiny blocks send groups the way of large buckets."""
    monkeypatch.setattr(minhash_dedup, "SMALL", small)
    monkeypatch.setattr(minhash_dedup, "BLOCK", 16 if small == 2 else 512)
    rng = random.Random(2)
    rows = [tuple(r) for r in awkward(spark).select("doc_id", "text").collect()]
    base = prose(rng, 150).split()
    for n in range(60):
        words = list(base)
        for _ in range(rng.randrange(12)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        rows.append((1000 + n, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = classes_by_hand(rows)
    for r in minhash_dedup.near_duplicates(docs).collect():
        own = NULL_ID if r["doc_id"] is None else r["doc_id"]
        got = NULL_ID if r["class_id"] is None else r["class_id"]
        assert got == want[own], r
    kept = minhash_dedup.deduplicated(awkward(spark))
    assert kept.columns == awkward(spark).columns
    assert minhash_dedup.near_duplicates(empty(docs)).count() == 0


def test_rows_that_share_an_id(spark):
    rng = random.Random(3)
    rows = [(1, prose(rng, 50)), (1, prose(rng, 50)), (1, None), (2, prose(rng, 50))]
    for order in (rows, rows[::-1]):
        kept = minhash_dedup.deduplicated(spark.createDataFrame(order, "doc_id long, text string"))
        assert {tuple(r) for r in kept.collect()} == {(1, None), rows[3]}


def test_near_duplicates_without_ids(spark):
    """Rows without an id don't bring together what is like each of them, and only copies go."""
    rng = random.Random(12)
    one, two, three = (prose(rng, 120) for _ in range(3))
    rows = [(None, one), (None, one), (None, two), (None, three), (None, ""), (None, None), (1, one + " more"), (2, two + " more"), (3, prose(rng, 120))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r["doc_id"], r["text"] or "") for r in minhash_dedup.deduplicated(docs).collect()]
    assert Counter(kept) == Counter([(None, one), (None, two), (None, three), (None, ""), rows[-1]])
    assert [(r["class_id"], r["n_copies"]) for r in minhash_dedup.near_duplicates(docs).where("doc_id = 3").collect()] == [(3, 1)]


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, i) for i in range(2001, 2100)]
    parent = {x: x for e in links for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got.get(x, x) == find(x) for x in parent)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 9: personal data ------------------------------------------------------------------------------------
def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def spans_by_hand(text):
    text, out = text or "", []
    out += [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans(spark):
    rng = random.Random(3)
    cases = ["", None, "a@b.com@c.org", "a@b.c-d%x@y.z", "é 1.2.3.4.5.6.7.8", "999.1.2.3.4 1.2.3.4", "000000000001.1.1.1", "4111111111111111" * 3, "4111 1111 1111 1111 5500-0000-0000-0004", "a@b.co " * 300]
    pieces = ["a", "@", ".", "1", "25", "+1", " ", "-", "(", ")", "%", "é", "😀", "4111111111111111", "9", "b.c", "\n"]
    cases += ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 40))) for _ in range(800)]
    cases += ["a" * 15_000, "1" * 15_000, "(" * 100_000, "@" * 50_000, "+1" * 30_000]
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    for r in pii.detected(docs, None).collect():
        assert [(s["kind"], s["start"], s["end"]) for s in r["base"]] == spans_by_hand(cases[r["doc_id"]])


WORDS_OF = {0: "mail|contact|write", 1: "host|addr|server", 2: "card|visa|pay|credit", 3: "phone|tel|call|fax|mobile"}


def left_by_hand(text):
    """Candidates of the loose patterns in what the base spans leave, as (kind, start, end)."""
    text, out = text or "", []
    hidden = list(text)
    for kind, pattern in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        now = "".join(hidden)
        for m in re.finditer(pattern, now):
            if any(k == kind and s == 0 and e == len(m[0]) for k, s, e in spans_by_hand(m[0])):
                hidden[m.start() : m.end()] = "\ufffc" * len(m[0])
    text = "".join(hidden)
    out += [(0, *m.span()) for m in re.finditer(r"[^\s@\ufffc]+@[^\s@\ufffc]+", text)]
    out += [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+ ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]+(?:(?:\.| ?[\[(](?:dot|DOT)[\])] ?)[A-Za-z0-9-]+)*", text)]
    out += [(4, *m.span()) for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text)]
    for m in re.finditer(r"\+?\(?[0-9]+(?:[ ().\[\]-]{1,3}[0-9]+)*", text):
        n = len(re.sub("[^0-9]", "", m[0]))
        out += [(kind, *m.span()) for kind, least, most in ((1, 4, 12), (2, 13, 19), (3, 7, 15)) if least <= n <= most and len(m[0]) <= 64]
    return text, out


def features_by_hand(text, kind, start, end):
    value, before, after = text[start:end], text[:start].lower(), text[end : end + 1]
    last, number = before[-1:], re.sub("[^0-9]", "", value)
    count = lambda chars: float(len(re.findall(chars, value)))
    parts = re.split("[^0-9]+", value)
    octets = re.fullmatch(r"([0-9]+)[^0-9]{1,3}([0-9]+)[^0-9]{1,3}([0-9]+)[^0-9]{1,3}([0-9]+)", value)
    out = {"size": float(end - start), "digits": count("[0-9]"), "dots": count(r"\."), "spaces": count("[ -]"), "brackets": count(r"[()\[\]]"), "lower": count("[a-z]"), "upper": count("[A-Z]")}
    out["turns"] = 1.0 + len(re.findall(r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])", value))
    out["plus"], out["zero"] = float(value[:1] == "+"), float(value[:1] == "0")
    out["domain"] = float(bool(re.search(r"(?:@|[\[(](?:at|AT)[\])] ?)[A-Za-z0-9-]+(?:\.| ?[\[(](?:dot|DOT)[\])] ?)[A-Za-z0-9]", value)))
    out |= {"groups": float(len(parts)), "longest": float(max(map(len, parts))), "luhn": float(12 <= len(number) <= 19 and luhn(number)), "octets": float(bool(octets) and all(int(x) <= 255 for x in octets.groups()))}
    out |= {"word_before": float(last.isalnum()), "word_after": float(after.isalnum()), "mark_before": float(last in tuple("#$%=/")), "quoted": float(last in ("'", '"'))}
    words = {"mails": WORDS_OF[0], "hosts": WORDS_OF[1], "pays": WORDS_OF[2], "calls": WORDS_OF[3], "counts": r"page|version|isbn|no\.|id"}
    return out | {name: float(bool(re.search(w, before[-24:]))) for name, w in words.items()}


def score_by_hand(trees, values):
    def walk(node):
        if isinstance(node, float):
            return node
        name, threshold, left, right = node
        return walk(left if values[trees.names[name]] <= threshold else right)

    return round(math.fsum(walk(t) * w for t, w in zip(trees.trees, trees.weights)), 3)


def personal(n, seed):
    """Lines with data of every kind, some in forms that no base detector takes, and numbers that are none."""
    rng = random.Random(seed)

    def card():
        digits = "".join(str(rng.randrange(10)) for _ in range(15))
        return next(digits + str(c) for c in range(10) if luhn(digits + str(c)))

    def other():
        digits = "".join(str(rng.randrange(10)) for _ in range(15))
        return next(digits + str(c) for c in range(10) if not luhn(digits + str(c)))

    def ip():
        return ".".join(str(rng.randrange(1, 256)) for _ in range(4))

    makers = [lambda: f"me{rng.randrange(9999)}@here.org", ip, card, lambda: f"+1 ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}", lambda: f'token = "{rng.randrange(16**40):040x}"',
              lambda: f"{rng.randrange(300, 900)}.{rng.randrange(999)}.7.{rng.randrange(300, 999)}", other, lambda: f"x{rng.randrange(99)}@here", lambda: f"{rng.randrange(10**6, 10**9)}", lambda: "supercalifragilistic" + rng.choice(WORDS),
              lambda: ip().replace(".", "[.]"), lambda: f"me{rng.randrange(9999)} [at] here.org", lambda: re.sub("(....)(?=.)", r"\1.", card()), lambda: f"00{rng.randrange(1, 9)} ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}"]
    weights = [20] * 10 + [1] * 4
    return [f"{prose(rng, 6).replace(chr(10), ' ')} {rng.choices(makers, weights)[0]()} {rng.choice(WORDS)} {rng.choices(makers, weights)[0]()}, the" for _ in range(n)]


@pytest.fixture(scope="module")
def learnt(spark):
    texts = personal(1500, 9)
    return texts, pii.learned(spark.createDataFrame([(t,) for t in texts], "text string"))


def test_spans_by_hand(spark, learnt):
    """Candidates, features, tree walks and thresholds in plain Python give the spans that are found."""
    texts, model = learnt
    assert set(model.thresholds) == {0, 1, 2, 3, 4}
    rng = random.Random(11)
    odd = ["", None, "a@b", "é@é 1[.]2[.]3[.]4 (at) x (at) y", "a@b.com@c.org x@y", "4111 1111 1111 1111.", "00 1 (017) 555-7713 0001", 'key: "' + "aB3" * 9 + '"', "1.2.3.4.5.6.7.8 [1] 2 (3)", "😀me [at] here [dot] org😀"]
    texts = personal(300, 10) + [rng.choice(texts) + " " + x for x in odd if x] + odd
    added = Counter()
    for r in pii.detected(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect():
        text = texts[r["doc_id"]] or ""
        base = spans_by_hand(text)
        assert [(s["kind"], s["start"], s["end"]) for s in r["base"]] == base
        hidden, left = left_by_hand(text)
        some = [c for c in left if score_by_hand(model.kinds[c[0]], features_by_hand(hidden, *c)) >= model.thresholds[c[0]]]
        assert [(s["kind"], s["start"], s["end"]) for s in r["found"]] == sorted(base + some), text
        added.update(c[0] for c in some)
    assert all(added[kind] > 0 for kind in range(5)), added


def test_added_spans_are_right(spark, learnt):
    """On lines not learned from: forms no base detector takes are found, and what is none is left alone."""
    rng, model = random.Random(13), learnt[1]
    good = ["203[.]20[.]113[.]77", "me7 [at] here.org", "4111.1111.1111.1111", "001 (017) 555-7713", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"']
    bad = ["9000[.]20[.]30[.]40", "x7@here", "4111.1111.1111.1112", "supercalifragilisticthe"]
    rows = [(i, f"{' '.join(rng.choices(WORDS, k=5))} {x} of") for i, x in enumerate((good + bad) * 4)]
    for r in pii.detected(spark.createDataFrame(rows, "doc_id long, text string"), model).collect():
        assert bool(len(r["found"])) == (r["doc_id"] % len(good + bad) < len(good)), r["text"]


def test_redaction_by_hand(spark, learnt):
    texts = personal(60, 12) + ["a@b.com", "é" * 1023 + "a@b.com" + "é" * 3000 + " 1.2.3.4", "a@1.2.3.4 a@b.com,c@d.org", "", None] + [" ".join(f"m{i}@b.org é" for i in range(500))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["found"] for r in pii.detected(docs, learnt[1]).collect()}
    for r in pii.redacted(docs, learnt[1]).collect():
        out, at, text = "", 0, texts[r["doc_id"]] or ""
        for start, end, kind in sorted((s["start"], s["end"], s["kind"]) for s in found[r["doc_id"]]):
            if start >= at:
                out += text[at:start] + f"[{pii.ALL_KINDS[kind].upper()}]"
            at = max(at, end)
        assert r["text"] == out + text[at:]
    assert pii.redacted(awkward(spark).where("doc_id = 14"), learnt[1]).first()["text"] == "mail [EMAIL] or [PHONE], [IP]"
    assert pii.redacted(awkward(spark), learnt[1]).columns == awkward(spark).columns


def test_very_many_spans_in_one_text(spark, learnt):
    """200,000 spans take time in proportion to the text."""
    began = time.monotonic()
    docs = spark.createDataFrame([(1, " ".join(f"m{i}@b.org" for i in range(200_000)))], "doc_id long, text string")
    assert pii.redacted(docs, learnt[1]).selectExpr("length(replace(text, '[EMAIL]', ''))").first()[0] == 199_999
    assert time.monotonic() - began < 120


def test_nothing_to_learn_from(spark):
    docs = awkward(spark)
    assert pii.learned(empty(docs)).thresholds == {}
    model = pii.learned(docs)
    assert set(model.kinds) <= {0, 1, 3}
    for r in pii.detected(docs, model).collect():
        assert {tuple(s) for s in r["base"]} <= {tuple(s) for s in r["found"]}
    assert pii.detected(empty(docs), model).count() == 0


def test_learning_sees_through_copies(spark):
    """Copies of one wrong candidate neither fill the sample nor hide that they are wrong."""
    texts = personal(900, 2) + [f"copied x{i}@there of" for i in range(30) for _ in range(200)]
    model = pii.learned(spark.createDataFrame([(t,) for t in texts], "text string"), sample=100)
    assert 0 in model.thresholds
    wrong = spark.createDataFrame([(1, "copied x7@there of")], "doc_id long, text string")
    assert len(pii.detected(wrong, model).first()["found"]) == 0


# all: names ------------------------------------------------------------------------------------------
@pytest.mark.parametrize("name", ["op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10"])
def test_clashing_names(spark, learnt, name):
    """Columns called as anything within an operator come back as they were."""
    inner = "doc drop __doc __drop __words __windows __lines __sorted __marks words lines row __row __url __host __best __sub1 __by_tld turn node h n items c base found scale".split()
    inner = [c for c in inner if not (name == "op9" and c in ("base", "found"))]
    docs = spark.createDataFrame([(i, prose(random.Random(i // 2), 60) + "\nThis line is found in very many documents.", f"http://a{i}.com/x/{i}", *[f"{c}{i}" for c in inner]) for i in range(8)], f"doc_id long, text string, url string, {', '.join(f'`{c}` string' for c in inner)}")
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, quality int")
    run = {
        "op3": lambda: packing.packed(docs), "op4": lambda: line_dedup.deduplicated(docs), "op5": lambda: url_filters.judged(docs), "op6": lambda: quality_rules.judged(docs), "op7": lambda: tokens.encoded(docs),
        "op8": lambda: minhash_dedup.deduplicated(docs), "op9": lambda: pii.detected(docs, learnt[1]), "op10": lambda: quality_classifier.scored(docs, labels),
    }[name]
    got = run()
    rows = got.collect()
    assert len(rows) == (4 if name == "op8" else 8)
    if name not in ("op3", "op10"):
        assert {(r["doc_id"], *[r[c] for c in inner]) for r in rows} <= {(i, *[f"{c}{i}" for c in inner]) for i in range(8)}


# 10: classifier --------------------------------------------------------------------------------------------
def test_classifier_on_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = {r["doc_id"]: r for r in quality_classifier.scored(documents(spark, sf), labels).collect()}
    held = [(rows[r["doc_id"]], r["quality"]) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert all(r["held_out"] for r, _ in held)
    assert sum(r["predicted"] == q for r, q in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows.values())


def scores_by_hand(rows, labelled):
    """rows: {id: vector}; labelled: [(id, label)]. Class covariances and log densities, plainly."""
    c = quality_classifier
    x, y = np.array([rows[d] for d, _ in labelled]), np.array([q for _, q in labelled])
    centre, scale = x.mean(0), np.maximum(x.std(0), c.FLOOR)
    z = (x - centre) / scale
    own = [np.cov(z[y == k].T, bias=True) for k in (0, 1)]
    common = sum((y == k).mean() * own[k] for k in (0, 1))
    common = (1 - c.DIAGONAL) * common + c.DIAGONAL * np.diag(np.diag(common))
    out = {}
    for d, v in rows.items():
        log = []
        for k in (0, 1):
            cov = (1 - c.SHRINK) * own[k] + c.SHRINK * common + c.FLOOR * np.eye(len(v))
            gap = (np.array(v) - centre) / scale - z[y == k].mean(0)
            log.append(-0.5 * gap @ np.linalg.solve(cov, gap) - 0.5 * np.linalg.slogdet(cov)[1] + np.log((y == k).mean()))
        out[d] = 1 / (1 + np.exp(-np.clip(log[1] - log[0], -500, 500)))
    return out


def test_classifier_by_hand(spark):
    docs, labels = documents(spark), spark.read.parquet(f"{SF}/labels.parquet")
    rows = {d: quality_classifier.statistics(t or "") for d, t in docs.select("doc_id", "text").collect()}
    known = [(d, q) for d, q in labels.select("doc_id", "quality").collect() if d in rows and q in (0, 1) and zlib.crc32(str(d).encode()) % 3 != 1]
    want = scores_by_hand(rows, known)
    got = {r["doc_id"]: r["score"] for r in quality_classifier.scored(docs, labels).collect()}
    assert got.keys() == want.keys() and max(abs(got[d] - want[d]) for d in want) < 1e-6


def test_statistics_by_hand():
    """Sizes and shares of a text, counted character by character."""
    for text in ("", "Ab c1! ab\nAb c1! ab\n\n# x, y é日", " \n ", "a a a a a a"):
        words, lines = re.findall(r"\S+", text), [x for x in text.split("\n") if x.strip()]
        threes = list(zip(words, words[1:], words[2:]))
        space, digit, upper = (sum(c in s for c in text) for s in (" \n", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        got = dict(zip(quality_classifier.NAMES, quality_classifier.statistics(text)))
        n, chars = len(words), max(len(text), 1)
        want = {"words": n, "word_size": (chars - space) / max(n, 1), "line_size": chars / max(len(lines), 1)}
        want |= {"distinct": 10 * len(set(words)) / max(n, 1), "again": 10 * (1 - len(set(threes)) / len(threes)) if threes else 0, "lines_again": 10 * (1 - len(set(lines)) / len(lines)) if lines else 0}
        want |= {"digits": 10 * digit / chars, "spaces": 10 * space / max(n, 1), "bare": 0 if n else 10}
        assert all(math.isclose(got[k], math.log1p(v), abs_tol=1e-12) for k, v in want.items()), text
        letters = sum(c.isalpha() for c in text)
        assert math.isclose(got["capitals"], math.log1p(10 * upper / max(letters, 1)), abs_tol=1e-12)


def test_classifier_edges(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (77, 0)], "doc_id long, quality int")
    assert {r["score"] for r in quality_classifier.scored(docs, labels.limit(0)).collect()} == {0.5}
    got = quality_classifier.scored(docs, labels).collect()
    assert len(got) == docs.count() and {r["score"] for r in got} <= {0.5, 1.0}
    assert quality_classifier.scored(empty(docs), labels).count() == 0
    both = spark.createDataFrame([(i, i % 2) for i in range(1, 15)], "doc_id long, quality int")
    assert all(0 <= r["score"] <= 1 for r in quality_classifier.scored(docs, both).collect())


# 1: search -----------------------------------------------------------------------------------------------
def best_by_hand(rows, queries, k=10):
    terms = [Counter(re.findall(r"[^\W_]+", (t or "").lower())) for _, t in rows]
    n, mean = len(rows), sum(sum(t.values()) for t in terms) / max(1, len(rows))
    df = Counter(w for t in terms for w in t)
    out = {}
    for q, text in queries:
        scored = []
        for (doc, _), t in zip(rows, terms):
            s = math.fsum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * t[w] * 2.2 / (t[w] + 1.2 * (0.25 + 0.75 * sum(t.values()) / mean)) for w in set(re.findall(r"[^\W_]+", (text or "").lower())) if w in t)
            if s > 0:
                scored.append((-round(s, 9), NULL_ID if doc is None else doc))
        out[q] = sorted(scored)[:k]
    return {q: v for q, v in out.items() if v}


@pytest.mark.parametrize("shard", [8192, 7])
def test_search(spark, monkeypatch, shard):
    monkeypatch.setattr(bm25, "SHARD_DOCS", shard)
    docs = documents(spark).select("doc_id", "text").union(awkward(spark).select("doc_id", "text"))
    rows = [tuple(r) for r in docs.collect()]
    queries = [(1, rows[3][1]), (2, "the"), (3, "The of license token"), (4, None), (5, ""), (6, "zzzz nothing"), (7, rows[40][1]), (8, "x")]
    got = defaultdict(list)
    for r in bm25.search(bm25.index(docs), spark.createDataFrame(queries, "query_id long, text string")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((-round(r["score"], 9), NULL_ID if r["doc_id"] is None else r["doc_id"]))
    want = best_by_hand(rows, queries)
    assert set(got) == set(want)
    for q in want:
        assert [d for _, d in got[q]] == [d for _, d in want[q]], q
        assert np.allclose([s for s, _ in got[q]], [s for s, _ in want[q]])
    assert bm25.search(bm25.index(empty(docs)), spark.createDataFrame(queries, "query_id long, text string")).count() == 0


def test_search_counts_every_repeat(spark):
    rows = [(1, "deep " * 200_000), (2, "deep " * 70_000 + "sea"), (3, "deep sea"), *[(i, f"sea {i}") for i in range(4, 20)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    queries = [(1, "deep"), (2, "deep sea")]
    got = defaultdict(list)
    for r in bm25.search(bm25.index(docs), spark.createDataFrame(queries, "query_id long, text string")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((-round(r["score"], 9), r["doc_id"]))
    assert got == best_by_hand(rows, queries)


def test_search_skips_blocks_for_long_queries(spark):
    """Whole documents as queries: the bounds leave most blocks unread, and the result is that of all documents."""
    docs = documents(spark, "/root/testdata/sf0.01").select("doc_id", "text")
    queries = docs.where("doc_id % 100 = 0").select(docs.doc_id.alias("query_id"), "text")
    pruning = bm25.Pruning()
    got = defaultdict(list)
    for r in bm25.search(bm25.index(docs), queries, 5, pruning).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["doc_id"])
    want = best_by_hand([tuple(r) for r in docs.collect()], [tuple(r) for r in queries.collect()], 5)
    assert got == {q: [d for _, d in best] for q, best in want.items()}
    assert 0 < pruning.scored < 0.6 * pruning.there


def test_like_queries_are_asked_together(monkeypatch):
    """Queries of two vocabularies by turns: each lot reads only the blocks of its own, and first thresholds from one shard hold for all."""
    rng = np.random.default_rng(5)
    tongue = lambda i: np.uint64(1000 * (i % 2)) + np.unique(np.append(rng.integers(0, 400, 60) ** 2 // 400, 0)).astype(np.uint64)
    texts = [tongue(i) for i in range(600)]
    counted = [(t, rng.integers(1, 9, len(t)) + 20 * (t % 1000 == 0)) for t in texts]
    asked = [tongue(i) for i in range(40)]
    df = Counter(t for own in texts for t in own.tolist())
    mean = sum(int(f.sum()) for _, f in counted) / 600
    weight = {t: math.log(1 + (600 - n + 0.5) / (n + 0.5)) for t, n in df.items()}
    asked = [np.array([t for t in own.tolist() if t in df], np.uint64) for own in asked]
    monkeypatch.setattr(bm25_index, "TOGETHER", 20)
    flat = np.concatenate(asked)
    order, queries = bm25_index.Queries.of(np.concatenate([[0], np.cumsum([len(a) for a in asked])]), flat, np.array([weight[t] for t in flat.tolist()]))
    assert sorted(order.tolist()) == list(range(40)) and all(len({i % 2 for i in order[a:b].tolist()}) == 1 for a, b in queries.groups())
    shards = [bm25_index.Shard.build(list(range(a, a + 200)), counted[a : a + 200]).ready(mean) for a in (0, 200, 400)]
    least, found = shards[0].floors(queries, 5)[:, 4], defaultdict(list)
    for s in shards:
        s.scored = s.there = 0
        for q, ids, scores in s.search(queries, 5, least):
            found[order[q]] += zip((-scores.round(9)).tolist(), ids.tolist())
        assert s.scored <= 0.6 * s.there
    for q, own in enumerate(asked):
        want = []
        for doc, (terms, tfs) in enumerate(counted):
            tf = dict(zip(terms.tolist(), tfs.tolist()))
            want.append((-round(sum(weight[t] * float(bm25_index.frequency_part(tf[t], int(tfs.sum()), mean)) for t in own.tolist() if t in tf), 9), doc))
        assert [d for _, d in sorted(found[q])[:5]] == [d for _, d in sorted(want)[:5]]
    rare = min(weight, key=lambda t: (-weight[t], t))  # queries without a frequent term, and without any the shards have
    few = bm25_index.Queries.of(np.array([0, 1, 2]), np.array([rare, 999_999], np.uint64), np.array([weight[rare], 1.0]))[1]
    for s in shards:
        s.floors(few, 5)
    assert sum(len(ids) for s in shards for _, ids, _ in s.search(few, 200, np.zeros(2))) == df[rare]
