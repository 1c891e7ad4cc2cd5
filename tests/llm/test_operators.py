"""The operators against brute force on a small table with every odd case, and on an empty one."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lattica.llm import components, exact_dedup, line_dedup, mixing, near_dedup, packing, repeats, token_counts, token_files, tokens, topk, toxicity

from .conftest import rows

GAP = r"[\x20\x09-\x0D]+"


def tokenizer(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.place(name))
    t.encode_special_tokens = True
    return t


def test_exact_dedup(docs, empty):
    norm = [(i, re.sub(GAP, " ", t or "")) for i, t, *_ in rows()]
    groups = defaultdict(list)
    for i, t in norm:
        groups[t].append(i)
    got = exact_dedup.exact_dedup(docs).collect()
    want = sorted((i, min(groups[t]), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm)
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(groups)
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_exact_dedup_of_a_hot_text(spark):
    d = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot  text").when(F.col("id") % 3 == 1, "hot text").otherwise(F.col("id").cast("string")).alias("text"))
    got = exact_dedup.exact_dedup(d).where("group_size > 1").agg(F.count(F.lit(1)), F.min("keep_id"), F.max("keep_id"), F.min("group_size"), F.count_if("kept")).first()
    assert tuple(got) == (2667, 0, 0, 2667, 1)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, 101), (102, 100), (7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 102: 100}


def test_near_dedup(docs, empty):
    sets, n = {}, {}
    for i, t, *_ in rows():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        n[i] = len(sets[i])
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    got = near_dedup.near_dedup(docs).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == sorted((i, n[i], root[i], root[i] == i) for i, *_ in rows())
    assert near_dedup.near_dedup(empty).count() == 0


def test_near_dedup_of_a_star(spark):
    """Copies that are near the original but not near each other, the original not the smallest."""
    base = [f"w{i}" for i in range(300)]
    docs = [(500, " ".join(base))]
    for k in range(300):
        w = list(base)
        for j in range(4):
            w[(k * 31 + j * 57) % 300] = f"x{k}_{j}"
        docs.append((k, " ".join(w)))
    got = near_dedup.near_dedup(spark.createDataFrame(docs, "doc_id long, text string")).select("component_id").distinct().collect()
    assert [r[0] for r in got] == [0]


def brute_repeats(texts):
    seen, out = set(), {}
    for i in sorted(texts):
        b = texts[i].encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            gone[p : p + 100] |= w in seen
            seen.add(w)
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out[i] = (len(b), kept)
    return out


def test_repeats(docs, empty):
    one = docs.dropDuplicates(["doc_id"])
    want = brute_repeats({i: t or "" for i, t, *_ in rows()})
    got = {r["doc_id"]: (r["n_bytes"], bytes(r["kept"])) for r in repeats.remove(one).collect()}
    assert got == want
    assert repeats.remove(empty).count() == 0


def test_repeats_of_a_split_anchor(spark, monkeypatch):
    monkeypatch.setattr(repeats, "TOGETHER", 3)
    passage = rows()[11][1][:400]
    texts = {i: f"{i * 977} start {'q' * (i % 7)} {passage} {'z' * (i % 5)} {i * 131} end" for i in range(20)}
    got = {r["doc_id"]: (r["n_bytes"], bytes(r["kept"])) for r in repeats.remove(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == brute_repeats(texts)


def test_maximal_repeats_hold_all_occurrences():
    t = "abcdefgh" * 3 + "".join(chr(97 + i * i % 23) for i in range(150)) + "xyz"
    u = "12345" + t[24:174] + "67890"
    data, segs = [t.encode(), u.encode()], []
    for d, raw in enumerate(data):
        for h, first, n in zip(*(c.tolist() for c in repeats.anchors(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))), strict=True):
            segs.append((h, d, first, n, raw[first : first + n + 99]))
    segs.sort()
    group, length, doc, at, first = repeats.maximal_repeats(*(np.array([s[k] for s in segs]) for k in (1, 2, 3)), np.frombuffer(b"".join(s[4] for s in segs), np.uint8))
    assert len(group) and (length >= 100).all() and set(doc.tolist()) == {0, 1} and first.sum() == len(set(group.tolist()))
    for g in set(group.tolist()):
        here = group == g
        assert len({data[d][p : p + n] for d, p, n in zip(doc[here], at[here], length[here], strict=True)}) == 1


def brute_groups(texts):
    """Longest stretches over which windows of 100 bytes have the same places: (length, places), from the places of each window."""
    places = defaultdict(list)
    for i, t in texts.items():
        for p in range(len(t) - 99):
            places[t[p : p + 100]].append((i, p))
    sets = {min(v): tuple(sorted(v)) for v in places.values() if len(v) > 1}
    out = set()
    for (i, p), v in sets.items():
        back = (i, p - 1)
        if back in sets and sets[back] == tuple((d, q - 1) for d, q in v):
            continue
        n = 100
        while sets.get((i, p + n - 99)) == tuple((d, q + n - 99) for d, q in v):
            n += 1
        out.add((n, v))
    return out


def test_covered_runs_are_the_union_of_their_spans():
    r = np.random.default_rng(5)
    doc, start, length = r.integers(0, 4, 60), r.integers(0, 300, 60), r.integers(1, 30, 60)
    bytes_ = {(d, i) for d, a, n in zip(doc, start, length, strict=True) for i in range(a, a + n)}
    runs = list(zip(*(c.tolist() for c in repeats.covered(doc, start, length)), strict=True))
    assert sorted(x for d, a, n in runs for x in ((d, i) for i in range(a, a + n))) == sorted(bytes_)
    assert all((d, a - 1) not in bytes_ and (d, a + n) not in bytes_ for d, a, n in runs)
    assert not len(repeats.covered(*[np.zeros(0, np.int64)] * 3)[0])


def test_repeat_groups(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choices("abcdefghij ", k=n))
    long, short, other = word(900), word(130), word(101)
    texts = {1: word(50) + long + word(40), 2: word(9) + short + word(70) + long, 3: long[:400] + word(30) + short + word(300) + other, 4: other + word(20), 5: word(500), 6: word(99)}
    docs = spark.createDataFrame([*texts.items(), (7, None), (8, "")], "doc_id long, text string")
    got = defaultdict(list)
    for g, n, d, p in repeats.repeat_groups(docs).collect():
        got[g, n].append((d, p))
    want = brute_groups(texts)
    mine = {(n, tuple(sorted(v))) for (_, n), v in got.items()}
    assert {(n, v) for n, v in mine if len(v) != 2 or v[0][0] != 1} == {(n, v) for n, v in want if len(v) != 2 or v[0][0] != 1}
    # the first 400 bytes have three places, the rest two; the whole of it is a maximal repeat of two as well
    assert {(d, p) for n, v in mine for d, p in v if n >= 400} >= {(1, 50), (2, 209), (3, 0)}
    for n, v in mine:
        assert n >= 100 and len({texts[d][p : p + n] for d, p in v}) == 1


def test_repeats_of_odd_rows(spark):
    """Periodic and long texts, null ids, ids that repeat with the same and with other texts, characters of several bytes."""
    rng = random.Random(4)
    base = "".join(rng.choices("abcdefghij é日", k=400))
    data = [(1, base), (1, base), (1, "x" + base[100:]), (None, base[50:300] + "tail"), (2, "ab " * 20_000), (3, "z" * 5000), (4, "ab " * 50), (None, None), (5, base[:99])]
    docs = spark.createDataFrame([(*r, 1, "a") for r in data], "doc_id long, text string, row int, doc string")
    order = sorted({*data}, key=lambda r: (r[0] is None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest()))
    want = brute_repeats({i: t or "" for i, (_, t) in enumerate(order)})
    want = Counter((d, *want[order.index((d, t))]) for d, t in data)
    assert Counter((r["doc_id"], r["n_bytes"], bytes(r["kept"])) for r in repeats.remove(docs).collect()) == want


def test_line_dedup(docs, empty):
    lines = {}
    for i, t, *_ in rows():
        for k, line in enumerate((t or "").split("\n")):
            n = re.sub(GAP, " ", line).strip(" ").lower()
            if n:
                lines[i, k] = n
    shingles = {p: {n[k : k + 8] for k in range(max(1, len(n) - 7))} for p, n in lines.items()}
    root = {p: p for p in lines}
    for _ in range(5):
        for a in lines:
            for b in lines:
                if len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b]):
                    root[a] = root[b] = min(root[a], root[b])
    got = {((r["doc_id"], r["line_no"]), (r["keep_doc"], r["keep_line"]), r["kept"]) for r in line_dedup.line_dedup(docs).collect()}
    assert got == {(p, root[p], p == root[p]) for p in lines}
    assert line_dedup.line_dedup(empty).count() == 0
    out = {r["doc_id"]: r["text"] for r in line_dedup.drop_repeated_lines(docs).collect()}
    assert len(out) == len({r[0] for r in rows()}) and out[4] is None and out[2] == ""


def sections(text):
    return [0] + [k + 1 for k, c in enumerate(text) if c == "\n" and k + 1 < len(text)]


def counted(text, offsets):
    """Tokens by the section in which they begin, and those that reach beyond it."""
    starts = sections(text)
    ends, n, over = [*starts[1:], len(text)], [0] * len(starts), [0] * len(starts)
    for a, z in offsets:
        k = max(k for k, s in enumerate(starts) if s <= a)
        n[k] += 1
        over[k] += z > ends[k]
    return n, over


def test_token_counts(docs, empty):
    t, got = tokenizer("byte_bpe_50k.json"), Counter()
    for r in token_counts.token_counts(docs).collect():
        got[tuple(r)] += 1
    want = Counter()
    for i, text, *_ in rows():
        text = text or ""
        starts = sections(text)
        n, over = counted(text, t.encode(text, add_special_tokens=False).offsets)
        want.update((i, k, a, z, n[k], over[k]) for k, (a, z) in enumerate(zip(starts, [*starts[1:], len(text)], strict=True)))
    assert got == want and max(want.values()) == 2  # the row that repeats is counted twice
    assert token_counts.token_counts(empty).count() == 0
    null = docs.select(F.lit(None).cast("long").alias("doc_id"), F.lit("a\nb").alias("text"), F.lit(1).alias("section")).limit(1)
    assert [tuple(r)[:4] for r in token_counts.token_counts(null).orderBy("section").collect()] == [(None, 0, 0, 2), (None, 1, 2, 3)]
    with pytest.raises(ValueError):
        token_counts.token_counts(docs, mark="--")


@pytest.mark.parametrize(("name", "cuts"), [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_encoding_in_pieces_is_that_of_the_whole(name, cuts, monkeypatch):
    monkeypatch.setattr(tokens, "HELD", 50)
    odd = ["a  b", " a \n b\n\nc", "x\t\ty \n", "don't stop.Now, it's\x1c.z", "é. ok", "  x　 y", "***!!! 12a3 b_c", "<|endoftext|> a", "", None]
    texts = [*odd, *(r[1] for r in rows())]
    t = tokenizer(name)
    want = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    enc = tokens.Encoder(name, cuts)
    for at in range(0, len(texts), 3):  # pieces are forgotten between the calls
        assert [x.tolist() for x in enc.encode(texts[at : at + 3])] == want[at : at + 3]
    assert [x.tolist() for x in enc.encode(texts)] == want


@pytest.mark.parametrize(("name", "cuts"), [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")])
def test_pieces_encode_as_whole_texts_do(name, cuts):
    enc = tokens.Encoder(name, cuts)
    rng = random.Random(5)
    signs = [*"abZé's.,-_<|>=1 7", " ", " ", "\n", "\t", "\r\n", "\x00", "\x1c", "\x85", "\xa0", " ", "̸", "́", "日", "'ll", "don't", "end", "<|endoftext|>"]
    texts = [None, "", " ", "  a", "a ", "a  \n b", "a\nb\nc", *("".join(rng.choices(signs, k=rng.randrange(40))) for _ in range(3000))]
    want = enc.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)
    for part in (pa.array(texts, pa.string()), pa.array(["x", *texts], pa.string()).slice(1)):
        assert [x.tolist() for x in enc.encode(part)] == [w.ids for w in want]
    assert enc.encode(pa.array([], pa.string())) == []


def test_token_files(spark, docs, empty, tmp_path):
    t, at = tokenizer("word_bpe_49k.json"), 0
    for k, d in enumerate((docs, empty)):
        token_files.write(d, str(tmp_path / str(k)), tokenizer="word_bpe_49k.json", cuts="word", end_id=2, block_ids=500)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], bytes(r["ids"])) for r in token_files.read(spark, str(tmp_path / "0")).collect())
    for (start, doc, n, ids), (i, text, *_) in zip(got, sorted(rows(), key=lambda r: (r[0], r[1] or "")), strict=True):
        want = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (start, doc, n, ids) == (at, i, len(want), want.tobytes())
        at += n
    assert token_files.read(spark, str(tmp_path / "1")).count() == 0


@pytest.mark.parametrize("bits", [1, 3, 16, 17, 31])
def test_bit_packing(bits):
    ids = (np.arange(1000, dtype=np.uint64) * 2654435761 % (1 << bits)).astype("<u4")
    packed = token_files.pack(ids, bits)
    assert len(packed) == -(-1000 * bits // 8)
    assert (token_files.unpack(packed, bits, 0, 1000) == ids).all() and (token_files.unpack(packed, bits, 333, 77) == ids[333:410]).all()
    with pytest.raises(ValueError):
        token_files.pack(np.array([1 << bits], np.uint32), bits)


def test_packing(docs, empty):
    t, got = tokenizer("byte_bpe_50k.json"), packing.pack(docs).collect()
    want = Counter()
    for i, text, *_ in rows():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want.update((i, a, zlib.crc32(ids[a : a + 2048].tobytes()), len(ids)) for a in range(0, len(ids), 2048))
    assert Counter((r["doc_id"], r["start"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] for r in got)
    windows = defaultdict(list)
    for r in got:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(empty).count() == 0


def test_minimum_slack():
    assert packing.fill({5: 2, 4: 1, 3: 3}, 11) in ({5: 1, 3: 2}, {4: 1, 3: 1, 4: 1}, {5: 1, 3: 2})
    assert sum(l * u for l, u in packing.fill({7: 1, 2: 1}, 8).items()) == 7
    counts = {l: 1 + l % 3 for l in range(1, 60)}
    found = packing.patterns(dict(counts), 64)
    used = Counter()
    for times, lengths in found:
        assert sum(l * u for l, u in lengths.items()) <= 64
        used.update({l: u * times for l, u in lengths.items()})
    assert used == Counter(counts)


def test_mixing(docs, empty):
    size = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, _, s in rows()]
    total = Counter()
    for _, s, n in size:
        total[s] += n
    weight = dict(zip(sorted(total, key=lambda s: (s is None, s or "")), [3, 1, 2] * 3, strict=False))
    target, left, open_ = {}, 1.5 * sum(total.values()), set(total)
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * total[s]}
        target |= {s: 2.0 * total[s] for s in full} | ({s: level * weight[s] for s in open_} if not full else {})
        if not full:
            break
        left, open_ = left - sum(2.0 * total[s] for s in full), open_ - full
    a, b = (sorted((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in mixing.mix(docs).collect()) for _ in range(2))
    assert a == b and [r[:2] for r in a] == sorted((i, n) for i, _, n in size) and all(r[4] <= 2 * r[1] for r in a)
    assert {(r[2], r[3]) for r in a} == {(total[s], round(target[s], 6)) for s in total}
    taken = Counter()
    for r in mixing.mix(docs).collect():
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 8 + 0.01 * target[s] for s in total)
    words = mixing.mixed(docs).select(F.sum(mixing.word_count())).first()[0]
    assert words == sum(taken.values()) and mixing.mixed(docs).columns == docs.columns
    assert mixing.mix(empty).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 8)).astype("float32")
    v[50:90] = v[50]
    data = [(i, [float(x) for x in v[i]], "x") for i in range(300)] + [(301, None, "x"), (320, [float("nan")] * 8, "x"), (340, [None] * 8, "x"), (360, [1.0], "x"), (None, [1.0] * 8, "x"), (20, [float(x) for x in v[20]], "x")]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, score string")
    got = defaultdict(list)
    for r in topk.top_k(topk.integer_vectors(df, "vec_id", "embedding"), block_rows=64).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    q = np.floor(64 * v.astype(float)).astype(int)
    own = [*range(300), 20]  # the row that repeats is a candidate of its own
    assert dict(got) == {i: sorted(((j, int(q[i] @ q[j])) for j in own if j != i), key=lambda x: (-x[1], x[0]))[:20] for i in range(0, 300, 20)}
    short = spark.createDataFrame([(k, [float(k)] * (2 + k % 2)) for k in range(30)] + [(40 + k, [7.0, 7.0]) for k in range(60)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in topk.top_k(topk.integer_vectors(short, "vec_id", "embedding"), k=5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    assert got == {0: [2, 4, 6, 8, 10], 20: [28, 26, 24, 22, 18], 40: [28, 26, 24, 22, 20], 60: [28, 26, 24, 22, 20], 80: [28, 26, 24, 22, 20]}
    assert topk.top_k(topk.integer_vectors(df.limit(0), "vec_id", "embedding")).count() == 0


def test_bounds_spare_reads():
    """Bounds hold the score, keep the k best, and leave most vectors out."""
    rng = np.random.default_rng(6)
    v = rng.integers(-40, 40, (2000, 16))
    edges = np.quantile(v.astype(float), np.linspace(0, 1, 65), axis=0).T
    q, c, low, up = topk.bounded(v[:20], np.arange(20), np.arange(2000), topk.approximate(v, edges), edges, 10)
    score = (v[q] * v[c]).sum(axis=1)
    assert (low <= score).all() and (score <= up).all() and len(q) < 20 * 500 and (q != c).all()
    for i in range(20):
        others = np.delete(np.arange(2000), i)
        assert set(others[np.argsort(-(v[others] @ v[i]), kind="stable")[:10]]) <= set(c[q == i])


def test_toxicity(spark, empty):
    rng = np.random.default_rng(7)
    words = [f"word{i}" for i in range(200)]
    data, labels = [], []
    for i in range(1500):
        toxic = i % 4 == 0
        t = list(rng.choice(words, 30)) + (["awfulslur"] if toxic else [])
        if toxic and i % 8 == 0:
            t.append("muslim")  # a group that is mentioned in toxic texts more than in others
        data.append((i, " ".join(t)))
        labels.append((i, int(toxic)))
    data.append((5000, None))
    docs, lab = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, lab, penalty=5.0)
    got = toxicity.scored(docs, model).withColumn("held", toxicity.held_out()).collect()
    held = [(r["score"] >= 0.5, dict(labels)[r["doc_id"]] == 1) for r in got if r["held"] and r["doc_id"] < 5000]
    assert sum(a == b for a, b in held) / len(held) > 0.97 and len(got) == 1501
    neutral = spark.createDataFrame([(1, "a muslim word1 word2 word3"), (2, "a word1 word2 word3")], "doc_id long, text string")
    with_, without = (toxicity.scored(neutral, m).orderBy("doc_id").collect() for m in (model, toxicity.fit(docs, lab, penalty=0.0)))
    assert with_[0]["score"] - with_[1]["score"] < without[0]["score"] - without[1]["score"]
    assert toxicity.scored(empty, toxicity.fit(empty, lab.limit(0))).count() == 0


def test_pipeline_stages_are_registered():
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near dedup", "mixing", "packing"]


def test_pipeline_stage_by_stage(spark, docs, tmp_path):
    """Each stage against what it should do with its own input, on the table with every odd case; run() gives the last stage's rows."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    some = docs.withColumn("text", F.when(F.col("doc_id").isin(8, 9), F.concat("text", F.lit(" vileword vileword2"))).otherwise(F.col("text")))
    some = some.unionByName(spark.range(300).select((F.col("id") + 1000).alias("doc_id"), F.concat(F.lit("plain text "), F.sha2(F.col("id").cast("string"), 256), F.when(F.col("id") % 3 == 0, " vileword vileword2").otherwise("")).alias("text"), F.lit("en").alias("lang"), F.lit("z").alias("source"), F.lit(9).cast("long").alias("n_chars"), F.lit(1).cast("long").alias("n"), F.lit("k").alias("key")))
    some.write.parquet(str(tmp_path / "documents.parquet"))
    spark.range(300).select((F.col("id") + 1000).alias("doc_id"), (F.col("id") % 3 == 0).cast("int").alias("toxic")).write.parquet(str(tmp_path / "labels.parquet"))
    now, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / f"stage{k}"))
        now = spark.read.parquet(str(tmp_path / f"stage{k}"))
        kept.append(now.collect())
        assert k == 4 or now.columns == some.columns
    clean, lines, near, mix, packed = kept
    assert {r["doc_id"] for r in some.collect()} - {r["doc_id"] for r in clean} == {8, 9, *range(1000, 1300, 3)}
    assert Counter(r["doc_id"] for r in lines) == Counter(r["doc_id"] for r in clean)
    seen = Counter(re.sub(GAP, " ", x).strip(" ").lower() for r in {r["doc_id"]: r for r in lines}.values() for x in (r["text"] or "").split("\n"))
    assert all(n == 1 for x, n in seen.items() if x)
    words = {r["doc_id"]: re.findall(r"[^\x20\x09-\x0D]+", (r["text"] or "").lower()) for r in near}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items() if w}
    assert not [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    assert {r["doc_id"] for r in near} >= {1, 4, 5, 6, 7, 11, 12, 20, 40}
    total = Counter()
    for r in near:
        total[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    taken = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in mix)
    assert abs(taken - 1.5 * sum(total.values())) <= len(total)
    t = tokenizer("byte_bpe_50k.json")
    assert sum(r["length"] for r in packed) == sum(len(t.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in mix)
    assert len(corpus_pipeline.run(spark, str(tmp_path)).collect()) == len(packed)


def test_line_prefix_pairs(spark):
    """The prefix join loses no pair of the similarity and keeps out a family that is alike but under it."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9))
    base = " ".join(word() for _ in range(30))
    lines = {i: f"{base} {' '.join(word() for _ in range(12))}" for i in range(40)}  # 300 of 400 shingles in common: similarity 0.55
    for i in range(40, 80):  # each a little changed from another
        other = lines[rng.randrange(i - 40, i)].split(" ")
        for _ in range(rng.randrange(3)):
            other[rng.randrange(len(other))] = word()
        lines[i] = " ".join(other)
    lines |= {200: "short", 201: "short!", 202: "s"}
    sets = {i: {x[k : k + 8] for k in range(max(1, len(x) - 7))} for i, x in lines.items()}
    df = spark.createDataFrame([(i, i, x, len(sets[i])) for i, x in lines.items()], "id long, root long, norm string, n int")
    alike = {(a, b) for a in sets for b in sets if a > b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    first = line_dedup.prefixes(df, 0.8, 8)
    pairs = line_dedup.prefix_pairs(first, 0.8)
    got = {(a, b) for a, b, ra, rb in pairs.collect() if (a, b) == (ra, rb)}
    assert alike and alike <= got
    assert not {p for p in got if p[0] < 40}
    assert {tuple(r) for r in line_dedup.confirmed(pairs.select("a", "b"), df, 0.8, 8).collect()} == alike
    links, want = ({r["node"]: r["root"] for r in components.components(e).collect()} for e in (line_dedup.linked(pairs, df, 0.8, 8), spark.createDataFrame(list(alike), "a long, b long")))
    assert links == want
    more, heads = line_dedup.joined_up(first, df, 0.8, 8)
    rest = line_dedup.linked(line_dedup.prefix_pairs(heads, 0.8), df, 0.8, 8)
    assert {r["node"]: r["root"] for r in components.components(more.union(rest)).collect()} == want


def test_copies_changed_too_much_are_not_paired(spark):
    """Lines made of one by the same few changes share their rare shingles, but most are under the similarity; those at or over it are all met."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9))
    base, others = [word() for _ in range(30)], [word() for _ in range(5)]
    lines = {}
    for i in range(150):
        lines[i] = list(base)
        for k in rng.sample(range(30), 3):
            lines[i][k] = rng.choice(others)
    lines = {i: " ".join(x) for i, x in lines.items()}
    sets = {i: {x[k : k + 8] for k in range(len(x) - 7)} for i, x in lines.items()}
    alike = {(a, b) for a in sets for b in sets if a > b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    near = {(a, b) for a in sets for b in sets if a > b and len(sets[a] & sets[b]) >= 0.75 * len(sets[a] | sets[b])}
    df = spark.createDataFrame([(i, i, x) for i, x in lines.items()], "id long, root long, norm string")
    got = {(r["a"], r["b"]) for r in line_dedup.prefix_pairs(line_dedup.prefixes(df, 0.8, 8), 0.8).collect()}
    assert alike and alike <= got <= near


def test_line_dedup_sees_every_character(spark):
    lines = ["https://www.alpha.org/x/one", "https://zeta.com/entirely/other", "https://zeta.com/entirely/other/", "你好世界再见朋友们今天天气很好", "你好世界再见朋友明天我们去爬山", "\U0001f600" * 9, "\U0001f601" * 9, "a\u2028bcdefghij", "a\u2028bcdefghik", "short", "shore"]
    shingles = [{n[k : k + 8] for k in range(max(1, len(n) - 7))} for n in lines]
    root = list(range(len(lines)))
    for _ in lines:
        for a in root[:]:
            for b, s in enumerate(shingles):
                if len(shingles[a] & s) >= 0.8 * len(shingles[a] | s):
                    root[a] = root[b] = min(root[a], root[b])
    docs = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")
    got = {r["line_no"]: r["keep_line"] for r in line_dedup.line_dedup(docs).collect()}
    assert got == dict(enumerate(root)) and sum(k != r for k, r in got.items()) == 1
    some = spark.createDataFrame([(n,) for n in lines], "norm string").select("norm", F.size(F.array_distinct(line_dedup.shingle_list(F.col("norm"), 8))).alias("n")).collect()
    assert [(r["norm"], r["n"]) for r in some] == [(n, len(s)) for n, s in zip(lines, shingles, strict=True)]


def test_rows_without_an_id_of_their_own_keep_their_lines(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    one, two, three = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60)), " ".join(f"u{i}" for i in range(60))
    texts = [(None, "u1\nx"), (None, "x\nu2"), (7, "first\nsame line"), (7, "same line\nother"), (7, "same line\nother"), (3, "line of three\nsame line"), (None, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = Counter((r["doc_id"], r["text"]) for r in line_dedup.drop_repeated_lines(docs).collect())
    # of the two null rows that hold x, the one where it is line 0 keeps it
    assert got == Counter([(None, "u1"), (None, "x\nu2"), (7, "first"), (7, "other"), (7, "other"), (3, "line of three\nsame line"), (None, None)])
    places = {(r["doc_id"], r["line_no"], r["keep_doc"], r["keep_line"], r["kept"]) for r in line_dedup.line_dedup(docs).where("doc_id is null").collect()}
    assert places == {(None, 0, None, 0, True), (None, 1, None, 1, True), (None, 1, None, 0, False)}
    docs = spark.createDataFrame([(1, one), (5, one + " more"), (5, two), (None, three), (None, three + " more"), (9, three)], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["text"][:2]) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    assert got == [("1", "w0"), ("5", "v0"), ("None", "u0")]


MARKED = ["a <|endoftext|> b", "<|startoftext|>x<|endoftext|>\n\n y", "<|ENDOFTEXT|> don't  stop", "<|endoftext|><|endoftext|>", "a\n<|endoftext|>\nb", "< |endoftext|> plain", "plain text"]


@pytest.mark.parametrize(("name", "cuts"), [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")])
def test_strings_of_added_tokens_are_their_ids(name, cuts):
    from tokenizers import Tokenizer

    plain, enc, rng = Tokenizer.from_file(tokens.place(name)), tokens.encoder(name, cuts), random.Random(8)
    signs = [*"ab .|<>", "\n", "  ", "é", "don't", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>"]
    texts = [*MARKED, None, "", *("".join(rng.choices(signs, k=rng.randrange(20))) for _ in range(2000))]
    want = [plain.encode(t or "", add_special_tokens=False) for t in texts]
    for part in (pa.array(texts, pa.string()), pa.array(["x", *texts], pa.string()).slice(1)):
        assert [x.tolist() for x in enc.encode(part)] == [w.ids for w in want]
    if cuts == "byte":
        texts += ["a\n\n\nb\n", "\n", " x\n y\n\n  z", "é\n\n日\n<|endoftext|>\nb\n", *("".join(rng.choices(["\n", " ", "a", "日", "\t", "end", ".", "<|endoftext|>"], k=rng.randrange(30))) for _ in range(2000))]
        part = pa.array([x or "" for x in ["cut off", *texts]], pa.string()).slice(1)
        first, starts = token_counts.section_starts(part, 10)
        n, over = token_counts.attributed(enc, part, "\n", first)
        for k, x in enumerate(part.to_pylist()):
            here = slice(first[k], first[k + 1])
            assert (starts[here].tolist(), n[here].tolist(), over[here].tolist()) == (sections(x), *counted(x, plain.encode(x, add_special_tokens=False).offsets))


def test_operators_encode_as_the_plain_call(spark, tmp_path):
    from tokenizers import Tokenizer

    word, byte = (Tokenizer.from_file(tokens.place(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    docs, at = spark.createDataFrame(list(enumerate(MARKED)), "doc_id long, text string"), 0
    token_files.write(docs, str(tmp_path / "0"), tokenizer="word_bpe_49k.json", cuts="word", end_id=2)
    for r, text in zip(token_files.read(spark, str(tmp_path / "0")).orderBy("doc_id").collect(), MARKED, strict=True):
        ids = [*word.encode(text, add_special_tokens=False).ids, 2]
        assert (r["start"], np.frombuffer(r["ids"], "<u4").tolist()) == (at, ids)
        at += len(ids)
    packed = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in packing.pack(docs).collect()}
    assert packed == {i: [*byte.encode(t, add_special_tokens=False).ids, 1] for i, t in enumerate(MARKED)}
    counts = Counter()
    for r in token_counts.token_counts(docs).collect():
        counts[r["doc_id"]] += r["n_tokens"]
    assert counts == Counter({i: len(byte.encode(t, add_special_tokens=False).ids) for i, t in enumerate(MARKED)})


def test_mixing_meets_small_targets_in_order(spark):
    """Many small sources beside a large one, with few slots: each meets its target, and the mix's order spreads the large ones."""
    data = [(k, f"s{k % 40:02d}", "w " * (1 + k % 3)) for k in range(400)] + [(1000 + k, "t", "v " * 50) for k in range(600)] + [(5000 + k, "u", "v " * 50) for k in range(600)]
    docs = spark.createDataFrame(data, "doc_id long, source string, text string")
    taken, target = Counter(), {}
    for r in mixing.mix(docs, slots=64).collect():
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] == r["first"] + r["again"] == sum(t["words"] for t in r["order"])
    assert len(target) == 42 and all(abs(taken[s] - target[s]) <= 0.5 for s in target)
    rows_ = mixing.mixed(docs, slots=64, with_order=True).collect()
    assert [r["slot"] for r in rows_] == sorted(r["slot"] for r in rows_)
    words = defaultdict(Counter)
    for r in rows_:
        words[r["source"]][r["slot"] // 16] += len(r["text"].split())
    assert {s: w.total() for s, w in words.items()} == dict(taken)
    assert all(abs(words[s][q] - target[s] / 4) <= 0.15 * target[s] for s in "tu" for q in range(4))


def test_lines_of_a_bucket_are_met_once_and_in_full(spark):
    """A pair that shares several buckets is one row; of a family in one bucket no similar pair of different roots is lost, and most others are kept out."""
    rng = random.Random(13)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9))
    base = [word() for _ in range(30)]
    lines = {i: " ".join(word() if k in rng.sample(range(30), rng.randrange(9)) else w for k, w in enumerate(base)) for i in range(60)}
    sets = {i: {x[k : k + 8] for k in range(len(x) - 7)} for i, x in lines.items()}
    alike = {(a, b) for a in sets for b in sets if a > b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    known = spark.createDataFrame([(i, x) for i, x in lines.items()], "id long, norm string")
    keys = {i: [7, 8, 9] if i % 2 else [7, 9] for i in lines}
    rows = spark.createDataFrame([(k, i, i // 2, keys[i]) for i in lines for k in keys[i]], "key long, id long, root long, keys array<long>")
    got = [tuple(r) for r in line_dedup.bucket_pairs(rows.join(line_dedup.sketches(line_dedup.shingles(known, 8)), "id"), 0.8).collect()]
    assert len(got) == len({(a, b) for a, b, _, _ in got}) and all((a // 2, b // 2) == (ra, rb) and ra != rb for a, b, ra, rb in got)
    want = {(a, b) for a, b in alike if a // 2 != b // 2}
    assert want and want <= {(a, b) for a, b, _, _ in got}
    minima = line_dedup.banded(known.select("norm", *line_dedup.line_key(F.col("norm"))), 8)
    assert minima.count() == len(set(lines.values()))


def test_line_bands_are_minima_over_every_shingle(spark):
    """Whatever their number, the last and the one of a short line too."""
    text = "".join(random.Random(3).choices("abcdefgh ", k=60)).strip()
    known = spark.createDataFrame([(text[:n],) for n in (1, 7, 8, 9, 23, 24, 25, 40, 55)], "norm string").withColumn("norm", F.trim("norm"))
    got = {tuple(r["keys"]) for r in line_dedup.banded(known.select("norm", *line_dedup.line_key(F.col("norm"))), 8).collect()}
    one = known.select("norm", F.explode(F.sequence(F.lit(1), F.greatest(F.length("norm") - 7, F.lit(1)))).alias("at"))
    one = one.select("norm", F.hash(F.encode(F.substring("norm", F.col("at"), F.lit(8)), "UTF-32")).alias("h"))
    low = one.groupBy("norm").agg(*[F.min(F.col("h").bitwiseXOR(F.lit(p))).alias(f"m{k}") for k, p in enumerate(line_dedup.POINTS)])
    want = low.select(F.array(*[F.xxhash64(F.lit(b), *[F.col(f"m{b * line_dedup.ROWS + r}") for r in range(line_dedup.ROWS)]) for b in range(line_dedup.BANDS)]).alias("keys"))
    assert got == {tuple(r["keys"]) for r in want.collect()} and len(got) > 5


def test_lines_that_share_no_first_band_meet_across_them(spark):
    """Two lines of one family whose first bands all differ, in a bucket with others: their pair is found by the bands across."""
    assert line_dedup.TRIPLES[: line_dedup.BANDS] == [[b * line_dedup.ROWS + r for r in range(line_dedup.ROWS)] for b in range(line_dedup.BANDS)]
    assert all(len({k // line_dedup.ROWS for k in t}) == line_dedup.ROWS for t in line_dedup.TRIPLES[line_dedup.BANDS :])
    one, other = list(range(18)), list(range(18))
    for b in range(line_dedup.BANDS):  # a minimum of each first band differs, none of the first band across does
        other[next(k for k in line_dedup.TRIPLES[b] if k not in line_dedup.TRIPLES[line_dedup.BANDS])] += 100
    df = spark.createDataFrame([(1, one), (2, other)], "id long, minima array<int>")
    a, b = (set(r["keys"]) for r in df.select("id", line_dedup.band_keys(F.col("minima"), slice(None)).alias("keys")).orderBy("id").collect())
    first = [set(r["keys"]) for r in df.select("id", line_dedup.band_keys(F.col("minima"), slice(line_dedup.BANDS)).alias("keys")).collect()]
    assert not first[0] & first[1] and a & b


def test_line_dedup_of_rows_once_and_often(spark):
    """Lines that are there once, several times, and like another one, in buckets of all sizes, against brute force."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(30)]
    texts = [" ".join(word() if k < i % 9 else w for k, w in enumerate(base)) for i in range(30)] + [word() for _ in range(20)]
    texts += [texts[0], texts[31], texts[31], " ".join(base[:-1])]
    sets = [{x[k : k + 8] for k in range(max(1, len(x) - 7))} for x in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for a in range(len(texts)):
            root[a] = min(root[b] for b in range(len(texts)) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["keep_doc"], r["kept"]) for r in line_dedup.line_dedup(docs).collect()}
    assert got == {(i, r, i == r) for i, r in enumerate(root)}
