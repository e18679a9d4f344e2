"""Each operator against brute force, SQL, an exact round trip or held-out accuracy, on small fixtures with edge cases."""

import hashlib
import random
import re
import time
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import bpe, common, decontaminate, language, lines, near, quality, queries, secrets, suffix, token_files, top_k

SF = "/root/testdata/sf0.001"
EDGES = [(900, None), (901, ""), (902, " "), (903, "x"), (904, "\n\n"), (905, "é" * 300), (906, "a" * 3000), (907, "The<|endoftext|> end. don't 漢字\x1c"), (908, "tie of two words"), (909, "tie of two words")]


@pytest.fixture(scope="module")
def texts():
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    return rows + EDGES


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(d, t, "en", 1) for d, t in texts], "doc_id long, text string, lang string, component_id int").repartition(3)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def words_of(text):
    return (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split()


def components(texts, k, percent):
    sets = {d: frozenset(zip(*[w[i:] for i in range(k)])) if len(w := words_of(t)) >= k else frozenset([tuple(w)] if w else []) for d, t in texts}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)) and x and 100 * (both := len(x & y)) >= percent * (len(x) + len(y) - both):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.fixture
def small_limits(monkeypatch):
    """So small that the ways for large data are taken: hot keys, no broadcasts by count."""
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    monkeypatch.setattr(common, "BROADCAST_IDS", 3)
    monkeypatch.setattr(suffix, "BROADCAST_IDS", 3)


#: Rows that share a doc_id with equal and with other texts, and rows without one.
REPEATED = [(908, "tie of two words"), (3000, "one text of a shared id that is here"), (3000, "another text of the shared id, not like it"), (3000, "another text of the shared id, not like it"), (None, "tie of two words"), (None, None), (None, "")]


@pytest.fixture(scope="module")
def repeated(spark, texts):
    return spark.createDataFrame([(d, t, "en", 1) for d, t in texts + REPEATED], "doc_id long, text string, lang string, component_id int").repartition(3)


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(docs, texts, k, monkeypatch):
    monkeypatch.setattr(near, "LEAF", 16)  # so that nodes branch and end in blocks
    want = components(texts, k, 80)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near.near_duplicates(docs, k).collect()}
    assert got == want


def test_near_duplicates_of_repeated_rows(repeated, texts, small_limits, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 2)
    want = components(texts + [(3000, REPEATED[1][1])], 2, 80)
    got = near.near_duplicates(repeated, 2).collect()
    assert len(got) == len(texts) + len(REPEATED)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == {d: c for d, (_, c) in want.items()}
    assert sorted((r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is None) == [(0, None, True), (0, None, True), (3, None, True)]
    assert sorted((r.n_shingles, r.kept) for r in got if r.doc_id == 3000) == [(8, True)] * 3


@pytest.mark.parametrize("leaf", [2048, 64])
def test_near_duplicates_recall(spark, leaf, monkeypatch):
    """Pairs at the threshold exactly, in nodes that branch (64) and in whole ones, with a hot group of distinct near copies."""
    monkeypatch.setattr(near, "LEAF", leaf)
    monkeypatch.setattr(near, "BLOCK", leaf // 4)
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    rows, base = [], [word() for _ in range(180)]
    for k in range(400):  # J = 80 / 100: 90 shingles each, 80 shared
        own, head, tail = [word() for _ in range(81)], [word() for _ in range(10)], [word() for _ in range(10)]
        rows += [(2 * k, " ".join(own + head)), (2 * k + 1, " ".join(own + tail))]
    for k in range(600):  # near copies of one text, each with words of its own
        rows.append((10_000 + k, " ".join(base[:90] + [word() for _ in range(5)] + base[95:])))
    got = {r.doc_id: r.component_id for r in near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert all(got[10_000 + k] == 10_000 for k in range(600))
    assert sum(got[2 * k + 1] == 2 * k for k in range(400)) == 400


def test_lines(docs, texts):
    owner = {}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(lines.LOWER)
    for d, t in sorted(texts, key=lambda x: x[0]):
        for x in (t or "").split("\n"):
            owner.setdefault(key(x), d)
    for r in lines.dedup_lines(docs).collect():
        own = (dict(texts)[r.doc_id] or "").split("\n")
        kept = [x for x in own if len(key(x)) < 10 or owner[key(x)] == r.doc_id]
        assert (r.n_lines, r.n_dropped, r.text) == (len(own), len(own) - len(kept), "\n".join(kept))


@pytest.mark.parametrize("limit", [lines.BROADCAST_BYTES, -1])
def test_lines_of_repeated_rows(repeated, small_limits, limit, monkeypatch):
    monkeypatch.setattr(lines, "BROADCAST_BYTES", limit)
    got = lines.dedup_lines(repeated).where("doc_id is null or doc_id in (908, 909, 3000)").collect()
    assert sorted((r.doc_id or 0, r.n_lines, r.n_dropped, r.text) for r in got) == sorted([(908, 1, 0, "tie of two words")] * 2 + [(909, 1, 1, ""), (0, 1, 0, ""), (0, 1, 0, ""), (0, 1, 0, "tie of two words")] + [(3000, 1, 0, t) for _, t in REPEATED[1:4]])


def test_lines_of_a_long_text(spark):
    """A text of 200,000 lines, of which every other one is in a smaller document."""
    rows = [(1, "\n".join(f"line number {i}" for i in range(0, 200_000, 2))), (2, "\n".join(f" Line Number {i}\t" for i in range(200_000)))]
    got = {r.doc_id: r for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].n_dropped == 0 and got[2].n_dropped == 100_000 and got[2].text.split("\n")[:2] == [" Line Number 1\t", " Line Number 3\t"]


def without_repeats(rows, length):
    """Brute force: rows of one doc_id and one text are one document."""
    seen, raw = {}, {(d, t): (t or "").encode() for d, t in rows if d is not None}
    for b in raw.values():
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    out = {}
    for k, b in raw.items():
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        out[k] = bytes(np.frombuffer(b, np.uint8)[~gone])
    return out


def kept_texts(spark, rows, length):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = suffix.remove_repeats(df, length).collect()
    assert sorted((r.doc_id or -1) for r in found) == sorted((d or -1) for d, _ in rows)
    texts = {}
    for r in found:
        texts.setdefault(r.doc_id, []).append(bytes(r.kept))
    return {d: sorted(x) for d, x in texts.items()}


def expected_texts(rows, length):
    kept, out = without_repeats(rows, length), {}
    for d, t in rows:
        out.setdefault(d, []).append((t or "").encode() if d is None else kept[d, t])
    return {d: sorted(x) for d, x in out.items()}


def test_suffix(spark, texts):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    one, two = word(310), word(250)
    shared = [(4000, one), (4000, two + one[:205]), (4000, two + one[:205]), (4001, two), (None, two), (None, one)]
    rows = texts + REPEATED + shared
    assert kept_texts(spark, rows, 200) == expected_texts(rows, 200)


def test_suffix_order_and_prefixes():
    rng = random.Random(3)
    for n, depth in [(rng.randint(1, 200), rng.choice([7, 20, 1000])) for _ in range(60)] + [(700, 20)]:
        codes = [rng.randint(1, rng.choice([1, 2, 4])) for _ in range(n)]
        order, again, h = suffix.suffix_order(np.array(codes, np.int16), depth)
        assert [codes[i : i + h] for i in order] == sorted(codes[i : i + h] for i in range(n))
        found = suffix.common_prefixes(np.array(codes, np.int16), order, again, h)
        for k in range(1, n):
            x, y = codes[order[k - 1] :], codes[order[k] :]
            same = next((i for i, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))
            assert found[k] == min(same, h) if same < h else found[k] >= h or found[k] == same
            assert (found[k] >= depth) == (same >= depth)


@pytest.mark.parametrize("shard, hot", [(600, 2000), (600, 3), (1500, 1)])
def test_shards_merge(spark, shard, hot, monkeypatch, small_limits):
    """Runs of one gram cut across shards, and dealt to several tasks, are merged by their digests."""
    monkeypatch.setattr(suffix, "SHARD", shard)
    monkeypatch.setattr(suffix, "HOT", hot)
    monkeypatch.setattr(suffix, "PIECE", 1000)
    rng = random.Random(shard + hot)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, other = word(230), word(150)
    rows = [(i, f"{i} {word(40)} {passage[: rng.randint(90, 230)]} {word(rng.randint(0, 60))}{other[rng.randint(0, 40) :]}") for i in range(40)]
    rows += [(100, "ab" * 900), (101, "x" + "ab" * 300), (102, word(3000)), (103, passage * 3)]
    assert kept_texts(spark, rows, 100) == expected_texts(rows, 100)
    one = pa.RecordBatch.from_pylist([{"gram": 7, "content": i, "n": 131, "copies": 1, "hot": False, "raw": (word(i + 1) + passage).encode()[-230:]} for i in range(20)])
    out = [b for b in suffix.shard_results(iter([one]), 100, 600) if b.num_rows and b.column("digest").null_count == 0]
    assert len(out) > 1  # several shards sent digests
    digests = pa.concat_batches(out)
    ordered = digests.take(pa.array(sorted(range(digests.num_rows), key=lambda i: digests.column("digest")[i].as_py())))
    halves = [ordered.slice(0, 11), ordered.slice(11, 0), ordered.slice(11)]  # strings of one digest in two batches
    counted = {}
    for x in ordered.column("digest").to_pylist():
        counted[x] = counted.get(x, 0) + 1
    assert sum(b.num_rows for b in suffix.merge_edges(iter(halves))) == sum(n for n in counted.values() if n > 1) > 0


def test_suffix_of_periodic_texts():
    """Neighbours that refinement leaves together aren't compared: 3 MB of periodic text take seconds."""
    began = time.time()
    contexts = [(b"0123456789" * 60_000)[k:] for k in range(5)]
    of, group = suffix.repeated_strings(contexts, np.array([len(c) - 199 for c in contexts]), 200)
    assert len(np.unique(group)) == 10 and time.time() - began < 60


def test_quality():
    good, bad = [f"the calm sea was near the town {i} and all was well. " * 8 for i in range(60)], [f"THE!! SEA!! {i} WAS!! %%% " * 12 for i in range(60)]
    net = quality.train(good[:40] + bad[:40], [1] * 40 + [0] * 40, 0.5)
    score = net.score(pa.array(good[40:] + bad[40:] + ["", None]))
    assert (score[:20] > 0.5).all() and (score[20:40] < 0.5).all() and np.isfinite(score).all()
    assert quality.train([], [], 0.5).score(pa.array(["x"])).tolist() == [0.5]


def test_quality_query(spark):
    """Held-out labels: the area under the curve, and the accuracy against always answering the more frequent label."""
    sf = "/root/testdata/sf0.1"
    scored = queries.op4_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality"), "doc_id").where("held_out and quality is not null").collect()
    y, score = np.array([r.quality for r in scored]), np.array([r.score for r in scored])
    ranks = np.empty(len(y))
    ranks[np.argsort(score, kind="stable")] = np.arange(1, len(y) + 1)
    positive = int(y.sum())
    area = (ranks[y == 1].sum() - positive * (positive + 1) / 2) / (positive * (len(y) - positive))
    right = np.mean([r.predicted == r.quality for r in scored])
    assert area > 0.97 and right > max(y.mean(), 1 - y.mean()) + 0.05
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in scored)


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(i, i % 2, "z") for i in range(40)] + [(None, 1, "z"), (5, None, "z"), (6, 7, "z")], "doc_id long, quality int, text string")
    rows = [(i, ("calm sea " if i % 2 else "!!## 77 ") * 20, 1.0) for i in range(40)] + [(None, "calm sea", 1.0), (50, None, 1.0), (51, "", 1.0), (51, "", 1.0), (52, "x" * 3_000_000, 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = quality.score_quality(df, quality.train_on(df, labels, F.lit(True))).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r.score for r in got}
    assert by_id[50] == by_id[51] and min(by_id[i] for i in range(1, 40, 2)) > max(by_id[i] for i in range(0, 40, 2))
    none = quality.train_on(df.limit(0), labels.limit(0), F.lit(True))
    assert {r.score for r in quality.score_quality(df, none).collect()} == {0.5}


def test_secrets(spark, texts):
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    more = ["token: secret: abcdefgh", "PassWord='aaaaaaaaaa' 🙂 api_KEY=12345678", "AKIAAKIAAKIA12345", "🙂" + "a" * 40 + " AKIA" + "Z" * 12, "AKIA" + "Z" * 11, "-----BEGIN RSA PRIVATE KEY-----"]
    rows = texts + list(enumerate(more, 1000)) + [(None, "secret = abcdefghi")]
    got = {(r.doc_id, r.text): [tuple(s) for s in r.spans] for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string"), secrets.BASE_RULES).join(spark.createDataFrame(rows, "d long, text string"), F.expr("doc_id <=> d")).select("doc_id", "text", "spans").collect()}
    for d, t in rows:
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t or "") if len(m[2]) >= 8]
        spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t or "") if len(m[0]) >= 16]
        spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t or "") if len(m[0]) >= 32]
        assert got[d, t] == sorted(spans)


def test_more_secrets(spark, monkeypatch, small_limits):
    """The rules beside the base ones, repeated rows and a text of many matches, with candidates that aren't broadcast."""
    key = "-----BEGIN OPENSSH PRIVATE KEY-----"
    rows = [(1, f"x {key} y"), (1, "nothing"), (1, f"x {key} y"), (2, "🙂 ghp_" + "Z1" * 18 + " -----BEGIN PRIVATE KEY-----"), (3, "ghp_short -----BEGIN PUBLIC KEY-----"), (None, key), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, [tuple(s) for s in r.spans]) for r in secrets.scan_secrets(df).collect())
    pem, bearer = 3, 4
    assert got == sorted([(1, [(2, pem, 2 + len(key))])] * 2 + [(1, []), (2, [(2, bearer, 42), (43, pem, 70)]), (3, []), (0, [(0, pem, len(key))]), (4, [])])
    many = "token=abcdefgh1 é " * 3000
    found = secrets.scan_secrets(spark.createDataFrame([(1, many)], "doc_id long, text string")).first().spans
    assert [tuple(s) for s in found] == [(18 * i, 0, 18 * i + 15) for i in range(3000)]


def test_top_k(spark):
    sql = duckdb.connect()
    sql.sql(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    want = sorted(sql.sql(queries.oracle_sql()["op6_top_k"]).fetchall())
    assert sorted(tuple(r) for r in queries.op6_top_k(spark, SF).collect()) == want


@pytest.mark.parametrize("blocks", [(4096, 512), (64, 16)])
def test_top_k_edges(spark, blocks, monkeypatch):
    """Nulls, NaN, ties, unequal lengths, repeated ids, large components, fewer candidates than k; against numpy in blocks of any size."""
    monkeypatch.setattr(top_k, "VECTOR_BLOCK", blocks[0])
    monkeypatch.setattr(top_k, "QUERY_BLOCK", blocks[1])
    rng = random.Random(2)
    rows = [(i, [rng.choice([-1.5, -0.25, 0.0, 0.5, 1.0]) for _ in range(rng.choice([3, 4]))], "x") for i in range(300)]
    rows += [(300, None, "x"), (301, [1.0, None], "x"), (302, [float("nan")] * 3, "x"), (303, [float("-inf"), 0.0, 0.0], "x"), (320, [], "x"), (340, [1e6, -1e6, 3.0], "x"), (None, [1.0, 1.0, 1.0], "x")]
    rows += [(20, [9.0, 9.0, 9.0], "x"), (40, rows[40][1], "x"), (41, rows[41][1], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    good = sorted({(i, tuple(int(np.floor(64 * c)) for c in v)) for i, v, _ in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)})
    for k in (1, 20, 1000):
        want = []
        for i, q in good:
            if i % 20 == 0:
                scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in good if j != i)
                want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
        assert sorted(tuple(r) for r in top_k.top_k(df, F.col("vec_id") % 20 == 0, k).collect()) == sorted(want)
    assert top_k.top_k(df.limit(0), F.col("vec_id") % 20 == 0, 3).count() == 0
    with pytest.raises(Exception, match="lower the scale"):
        top_k.top_k(spark.createDataFrame([(20, [1e300])], "vec_id long, embedding array<double>"), F.lit(True), 3).collect()


def test_bpe(docs, texts):
    path = queries.tokenizer("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    two = {r.doc_id: r for r in bpe.decode_documents(bpe.encode_documents(docs, path), path).collect()}
    for r in bpe.round_trip(docs.union(docs.where("doc_id < 20")), path).collect():
        ids = library.encode(dict(texts)[r.doc_id] or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids
        assert r.decoded == library.decode(ids, skip_special_tokens=False)
        assert r == two[r.doc_id]


WHITE = [" ", "  ", "\t", "\n", "\r\n", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u202f", "\u205f", "\u3000", "\u200b", "\ufeff"]


def test_bpe_chunks():
    """Any white space beside any character, in texts that lie one after another in one batch."""
    path, rng = queries.tokenizer("byte_bpe_50k.json"), random.Random(5)
    library, own = Tokenizer.from_file(path), bpe.byte_bpe(path)
    words = ["a", "é", "là", "Ä", "ß", "日本", "語", "ぁ", "don't", "12", "...", "<|endoftext|>", "\U0001f600", "\u2019s", "\xab", "Â", "ა", "ⴀ"]
    texts = ["".join(rng.choice(WHITE if rng.random() < 0.55 else words) for _ in range(rng.randint(0, 12))) for _ in range(4000)] + ["", None, " ", "x" * 100_000]
    ids = own.encode_array(pa.array(texts))
    for part in (slice(0, None), slice(7, 9), slice(0, 0)):
        assert own.encode_array(pa.array(texts).slice(part.start, None if part.stop is None else part.stop - part.start)).to_pylist() == ids.to_pylist()[part]
    wanted = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in ids.to_pylist()] == wanted
    assert bpe.decode_array(bpe.token_table(path), ids).to_pylist() == [library.decode(w, skip_special_tokens=False) for w in wanted]
    loose = pa.array([np.array([0, 1, 223, 94, 50256], "<u4").tobytes(), None, b"", np.arange(130, 250, dtype="<u4").tobytes()])
    assert bpe.decode_array(bpe.token_table(path), loose).to_pylist() == [library.decode(np.frombuffer(x or b"", "<u4").tolist(), skip_special_tokens=False) for x in loose.to_pylist()]


def overlaps(rows, items):
    """Brute force over all alignments."""
    tokens = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    want = set()
    for d, t in rows:
        w, places = tokens(t), {}
        for k, x in enumerate(w):
            places.setdefault(x, []).append(k)
        for i, b in ((i, tokens(b)) for i, b in items):
            shifts = Counter(k - j for j, x in enumerate(b) for k in places.get(x, ()))
            for o in (o for o, n in shifts.items() if n >= min(10, len(b))):
                same = [w[o + k] == b[k] for k in range(max(0, -o), min(len(b), len(w) - o))]
                if len(b) < 12 and len(same) == len(b) > 0 and all(same):
                    want.add((d, i))
                elif sum(same) >= 10 and max(sum(same[s : s + 12]) for s in range(len(same) - 11)) >= 10:
                    want.add((d, i))
    return {(d, i) for d, i in want if d is not None and i is not None}


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_BYTES, -1])
def test_decontaminate(spark, texts, limit, monkeypatch):
    """With the seeds broadcast, and by the shuffle for larger benchmarks; with items of any length."""
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", limit)
    tokens = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    items += [(500, "Tie of TWO words"), (501, "zebra"), (502, "nine words are more than a span has here"), (503, None), (504, "..."), (None, "of two"), (501, "zebra"), (506, "a b c d e f g"), (507, "b")]
    changed = tokens(items[0][1])[:14]
    changed[4], changed[9] = "zzz", "yyy"
    rows = texts + REPEATED + [(2000, "before " + " ".join(changed) + " after"), (2001, " ".join(tokens(items[1][1])[:9])), (2002, "a zebra, and nine words are more than a span has here"), (2002, "a zebra"), (2003, "a b c d e f g"), (2004, "nine words are more than a span has")]
    found = decontaminate.find_overlaps(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = [(r.doc_id, r.item_id) for r in found.collect()]
    want = overlaps(rows, items)
    assert len(got) == len(set(got)) and set(got) == want
    assert {(2000, items[0][0]), (2002, 501), (2002, 502), (908, 500), (2003, 506), (2003, 507)} <= want and 2001 not in {d for d, _ in want} and 2004 not in {d for d, _ in want}


def test_decontaminate_long_documents(spark, monkeypatch):
    """20,000 words that repeat an item over and over, without broadcasts: seeds carry no whole texts."""
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", -1)
    item = " ".join(f"w{i}" for i in range(100))
    df = spark.createDataFrame([(i, " ".join([item] * 200)) for i in range(4)] + [(9, "w1 w2 w3")], "doc_id long, text string")
    assert sorted(tuple(r) for r in decontaminate.find_overlaps(df, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()) == [(i, 1, 12) for i in range(4)]


def test_language_gradients():
    net = language.BiGRU(["a", "b", "c"], 3)
    rows, y = np.random.default_rng(0).integers(0, 256, (5, 9)).astype(np.int16), np.array([0, 1, 2, 1, 0])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    loss = lambda: -np.log(net.probabilities(net.logits(rows).astype(np.float64))[:, np.arange(5), y]).mean()
    for k, g in net.gradients(rows, y).items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        net.p[k][at] += 1e-3
        up = loss()
        net.p[k][at] -= 2e-3
        assert g[at] == pytest.approx((up - loss()) / 2e-3, rel=1e-2)
        net.p[k][at] += 1e-3


def test_language(spark):
    r = queries.op9_language(spark, "/root/testdata/sf0.01")
    true = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    share = r.join(true, "doc_id").where("held_out").selectExpr("avg(int(lang = lang_pred))").first()[0]
    assert share > 0.95
    edges = spark.createDataFrame([(1, None), (2, "12 34"), (3, "the sea")], "doc_id long, text string")
    assert [x.lang_pred for x in language.identify(edges, language.train(["the sea", "la mer"], ["en", "fr"])).orderBy("doc_id").collect()][:2] == ["und", "und"]
    assert language.train([], []) is None


def test_language_of_odd_rows(spark):
    net = language.train(["the sea and the town " * 9, "la mer et la ville " * 9], ["en", "fr"])
    rows = [(1, "the sea and the town", "x"), (1, "the sea and the town", "x"), (None, "la mer et la ville", "x"), (2, "", "x"), (3, "the town " * 100_000, "x"), (4, "!?", "x")]
    got = [(r.doc_id, r.lang_pred, r.score) for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, score string"), net).collect()]
    assert [g[:2] for g in got] == [(1, "en"), (1, "en"), (None, "fr"), (2, "und"), (3, "en"), (4, "und")]
    assert got[0] == got[1] and all(0 <= s <= 1 for _, _, s in got) and got[3][2] == got[5][2] == 0
    assert {r.lang_pred for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, score string"), None).collect()} == {"und"}


def test_training_rows(spark):
    rows = spark.range(3000).select("id", F.expr("id % 500").alias("doc_id"), F.expr("if(id % 3 = 0, null, 'text ' || id)").alias("text"), F.expr("if(id % 7 = 0, null, 'en')").alias("lang"))
    everything = rows.where("text is not null and lang is not null").selectExpr("xxhash64(doc_id) as h", f"array_repeat(text, {language.DRAWS}) as t", "lang").orderBy("h", "lang", "t").collect()
    for limit in (1, 100, 5000):
        found = language.training_rows(rows, F.lit(True), limit)
        assert [tuple(r) for r in found] == [tuple(r) for r in everything[:limit]]
    long = spark.createDataFrame([(1, "".join(chr(0x4E00 + i) for i in range(20_000)), "zh")], "doc_id long, text string, lang string")
    drawn = language.training_rows(long, F.lit(True), 1)[0].stretches
    assert all(len(x) == language.DRAW_CHARS for x in drawn) and max(map(max, drawn)) > chr(0x4E00 + 15_000) and min(map(min, drawn)) < chr(0x4E00 + 5_000)


def test_token_files(docs, texts):
    path = queries.tokenizer("word_bpe_49k.json")
    library, start = Tokenizer.from_file(path), 0
    got = {r.doc_id: r for r in token_files.token_files(docs, path, 2).collect()}
    for d, t in sorted(texts, key=lambda x: x[0]):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert (got[d].start, np.frombuffer(bytes(got[d].ids), "<u4").tolist()) == (start, ids)
        start += len(ids)


def test_token_files_of_repeated_rows(spark):
    """Rows without an id, a real -1, and one id that most rows have: starts add up, nothing is lost or mixed up."""
    path = queries.tokenizer("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = [(None, "no id"), (None, None), (-1, "real one"), (7, "a long text " * 20_000)] + [(5, f"row number {i}") for i in range(300)] + [(i, "x" * i) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = sorted(token_files.token_files(df, path, 2).collect(), key=lambda r: r.start)
    ids = [np.frombuffer(bytes(r.ids), "<u4").tolist() for r in found]
    wanted = lambda t: [*library.encode(t or "", add_special_tokens=False).ids, 2]
    assert [r.start for r in found] == np.cumsum([0, *map(len, ids)])[:-1].tolist()
    assert [r.doc_id for r in found] == [None, None] + sorted(d for d, _ in rows if d is not None)
    assert sorted((r.doc_id or 0, r.doc_id is None, i) for r, i in zip(found, ids)) == sorted((d or 0, d is None, wanted(t)) for d, t in rows)


def test_token_files_of_a_second_attempt(spark, tmp_path):
    """What an attempt that didn't count has left behind is neither read nor kept."""
    encoded = spark.createDataFrame([(i, np.arange(i, dtype="<u4").tobytes()) for i in range(50)], "doc_id long, ids binary")
    (tmp_path / "part-00000-dead.tkv").write_bytes(b"half a file")
    files = token_files.write_token_files(spark, encoded, f"file://{tmp_path}")
    assert sorted(f for f, _, _ in files) == sorted(p.name for p in tmp_path.glob("*.tkv"))
    assert {r.doc_id: bytes(r.ids) for r in token_files.read_token_files(spark, f"file://{tmp_path}", files).collect()} == {i: np.arange(i, dtype="<u4").tobytes() for i in range(50)}


def test_shared_folder(spark):
    class Unset:
        def __init__(self, master):
            self.conf = self.sparkContext = self
            self.master, self.made = master, None

        def get(self, key, default=None):
            return default

        def getConf(self):  # noqa: N802
            return self

        def setCheckpointDir(self, path):  # noqa: N802
            self.made = path

        def set(self, key, value):
            assert (key, value) == ("spark.checkpoint.dir", self.made)

    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1000]"):
        with pytest.raises(RuntimeError):
            common.shared_dir(Unset(master))
    assert common.shared_dir(Unset("local[4]")).startswith("file:") and common.shared_dir(spark)


@pytest.mark.parametrize("bound", [0, 1000])
def test_join_one(spark, bound, monkeypatch):
    """Hot keys and many null ones, against a plain join; and documents with and without a set of ids."""
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    monkeypatch.setattr(common, "BROADCAST_IDS", bound)
    rows = spark.createDataFrame([(k, i) for k, n in ((1, 10), (2, 1), (3, 5), (None, 4)) for i in range(n)], "doc_id long, i int")
    one = spark.createDataFrame([(1, "a"), (2, "b"), (4, "d")], "doc_id long, v string")
    ordered = lambda df: sorted(map(tuple, df.collect()), key=repr)
    for how in ("inner", "left"):
        assert ordered(common.join_one(rows, one, ["doc_id"], how)) == ordered(rows.join(one, ["doc_id"], how))
    assert ordered(common.with_ids(rows, one)) == ordered(rows.join(one, ["doc_id"], "left"))
    assert ordered(common.without_ids(rows, one.select("doc_id"))) == ordered(rows.join(one, ["doc_id"], "left_anti"))


def test_encode_slice():
    encoder = token_files.chunk_encoder(queries.tokenizer("word_bpe_49k.json"))
    texts = pa.array(["", " ", "a\x0bb c\x0cd", "\n\n", "Ärger, größe. x", " lead", "trail ", "tab\tx\r\ny", "日本 語", "don't stop!!", "İstanbul ß ſ", " nb\u3000sp", "a" * 5000, "é café,"])
    for part in (texts, texts.slice(3, 5), texts.slice(0, 0), texts.slice(0, 1)):
        wanted = [[*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in part.to_pylist()]
        found = token_files.encode_slice(part, encoder, (2).to_bytes(4, "little"))
        assert [np.frombuffer(x, "<u4").tolist() for x in found.to_pylist()] == wanted


def test_packing():
    ranks = np.array([0, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1], np.uint32)
    control, data = token_files.pack(ranks)
    assert (token_files.unpack(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), np.array([7])) == ranks).all()


def test_empty_tables(spark):
    none, path = empty(spark), queries.tokenizer("byte_bpe_50k.json")
    found = [near.near_duplicates(none), lines.dedup_lines(none), suffix.remove_repeats(none), quality.score_quality(none, quality.train([], [], 0.5)), secrets.scan_secrets(none)]
    found += [bpe.encode_documents(none, path), language.identify(none, None), token_files.token_files(none, queries.tokenizer("word_bpe_49k.json"), 2)]
    found += [decontaminate.find_overlaps(none, none.withColumnRenamed("doc_id", "item_id"))]
    assert [df.count() for df in found] == [0] * len(found)


def test_pipeline(spark, tmp_path):
    sea = "the calm sea was near the old town and all the boats came home before the night fell"
    item = "which of the seven rivers that cross the northern plain reaches the sea last of all in spring"
    rows = [(1, sea, "en"), (2, sea + " again", "en"), (3, "1234 5678", "en"), (4, f"quiz note {item} was asked", "en"), (5, f"a line that repeats here\nunique words of number five and {sea[:20]}", "en"), (6, "a line that repeats here\nother words stand in number six", "en")]
    df = spark.createDataFrame([(d, t, x, "s", len(t)) for d, t, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {1, 5, 6}
    assert got[6].decoded_sha256 == hashlib.sha256(b"other words stand in number six").hexdigest()


PIPELINE_COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def pipeline_by_brute_force(spark, rows, items):
    """(doc_id, text) that remain, stage by stage on what the stage before kept; the language model is the operator's own."""
    df = spark.createDataFrame(rows, PIPELINE_COLUMNS)
    net = language.train_on(df, common.crc_mod("doc_id", 3) != 1)
    known = language.identify(df, net).collect()
    rejected = {r.doc_id for r in known if r.lang_pred == "und" or r.score < corpus_pipeline.LEAST_SCORE}
    kept = [(d, t) for d, t, *_ in rows if d is None or d not in rejected]
    owner = {}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(lines.LOWER)
    for d, t in kept:
        for x in (t or "").split("\n"):
            if d is not None:
                owner[key(x)] = min(d, owner.get(key(x), d))
    kept = [(d, t if d is None else "\n".join(x for x in (t or "").split("\n") if len(key(x)) < 10 or owner[key(x)] == d)) for d, t in kept]
    kept = [(d, t or "") for d, t in kept]
    groups = components([(d, t) for d, t in kept if d is not None], 5, 80)
    kept = [(d, t) for d, t in kept if d is None or groups[d][1] == d]
    leaked = {d for d, _ in overlaps(kept, items)}
    return [(d, t) for d, t in kept if d not in leaked]


def test_pipeline_against_brute_force(spark, texts, tmp_path):
    """All five stages, with null ids and texts, repeated rows, ties, a text of 100,000 words and copies of it."""
    rng = random.Random(8)
    words = "the calm sea was near an old town and all of its boats came home".split()
    long = " ".join(rng.choice(words) for _ in range(100_000))
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    more = [(7000, long), (7001, long + " again"), (7002, None), (7003, "repeated row of the sea and the town"), (7003, "repeated row of the sea and the town"), (None, "a row without an id near the sea"), (None, None), (7004, f"the town {items[0][1]} the sea")]
    rows = [(d, t, "en" if d is None or d % 2 else None, "s", len(t or "")) for d, t in texts + more]
    spark.createDataFrame(rows, PIPELINE_COLUMNS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = pipeline_by_brute_force(spark, rows, items)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted((r.doc_id or -1, r.decoded_sha256) for r in got) == sorted((d or -1, digest(t)) for d, t in want)
    library = Tokenizer.from_file(queries.tokenizer("byte_bpe_50k.json"))
    counts = {d: len(library.encode(t, add_special_tokens=False).ids) for d, t in want if d is not None}
    assert {r.doc_id: r.n_tokens for r in got if r.doc_id is not None} == counts and 7004 not in counts and 7001 not in counts


def test_pipeline_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], PIPELINE_COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
