"""The corpus operators against brute force on small fixtures, with their edge cases."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import pytest

from quern.llm import decontam, fingerprint, jaccard, packing, quality, substring, suffix, tokencount, toxicity, url_filter

TOKENIZER = __import__("public_tokenizers").path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, spans string, run string, shard string, key string"
SPACE = rb"[^\x20\x09-\x0D]+"


def sentence(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" + rng.choice(["", ",", "é"]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Passages, exact and near copies, repeated rows, nulls, empty and long texts, in no order."""
    rng = random.Random(3)
    passage = sentence(rng, 70)
    out = [(i, sentence(rng, rng.randrange(1, 160), 5000)) for i in range(60)]
    out += [(100 + i, sentence(rng, rng.randrange(0, 40), 5000) + " " + passage + " " + sentence(rng, 20, 5000)) for i in range(12)]
    base = sentence(rng, 200, 5000)
    out += [(200 + i, base) for i in range(5)]
    for i in range(8):
        words = base.split()
        for _ in range(i + 1):
            words[rng.randrange(len(words))] = f"new{rng.randrange(99)}"
        out.append((300 + i, " ".join(words)))
    out += [(400, ""), (401, None), (402, " \t\n "), (403, "one two"), (404, "One TWO"), (405, "a " * 3000), (406, "x" * 1500), (407, "no spaces here é" * 40), (408, sentence(rng, 4000, 900))]
    out += [(409, out[3][1]), (500, sentence(rng, 30, 5000))]
    out += [out[-1], (None, "null id text " * 30)]  # a row that repeats, a null id
    rng.shuffle(out)
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "a", "b", "c", "d", "e") for i, t in rows], SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def distinct_rows(rows):
    """Documents by order: the null id first."""
    return sorted({(-1 if i is None else i, t or "") for i, t in rows})


@pytest.mark.parametrize("hot", [4096, 1])
def test_substring_dedup(spark, texts, hot):
    spec = substring.SPEC._replace(hot=hot)
    got = {(r["doc_id"] if r["doc_id"] is not None else -1): tuple(r)[1:] for r in substring.removals(frame(spark, texts), spec).collect()}
    first = {}
    for i, t in distinct_rows(texts):
        w = re.findall(SPACE, t.encode())
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            if first.setdefault(tuple(w[s : s + 20]), (i, s)) != (i, s):
                gone[s : s + 20] = [True] * 20
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert got[i] == (len(w), sum(gone), hashlib.sha256(kept).hexdigest()), i
    assert len(substring.removals(frame(spark, texts), spec).collect()) == len(texts)
    assert substring.removals(empty(spark)).collect() == []


def without_repeats(rows):
    count = collections.Counter(t.encode()[s : s + 200] for _, t in rows for s in range(len(t.encode()) - 199))
    for i, t in rows:
        b = t.encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 199):
            if count[b[s : s + 200]] > 1:
                gone[s : s + 200] = b"\1" * 200
        yield i, b, bytes(gone)


@pytest.mark.parametrize("hot", [4096, 1])
def test_suffix_dedup(spark, texts, hot):
    spec = suffix.SPEC._replace(hot=hot)
    got = {(r["doc_id"] if r["doc_id"] is not None else -1): tuple(r)[1:] for r in suffix.removals(frame(spark, texts), spec).collect()}
    for i, b, gone in without_repeats(distinct_rows(texts)):
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        assert got[i] == (len(b), sum(gone), len(re.findall(b"\1+", gone)), hashlib.sha256(kept).hexdigest()), i
    assert suffix.removals(empty(spark)).collect() == []


def test_suffix_stage(spark, texts):
    out = suffix.deduplicated(frame(spark, texts))
    assert out.columns == [x.split()[0] for x in SCHEMA.split(", ")]
    got = {(r["doc_id"] if r["doc_id"] is not None else -1): r for r in out.collect()}
    for i, b, gone in without_repeats(distinct_rows(texts)):
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")
        assert (got[i]["text"] or "") == kept and got[i]["n_chars"] == len(kept)
    assert got[401]["text"] is None


@pytest.mark.parametrize("seed", range(40))
def test_suffix_array(seed):
    rng = random.Random(seed)
    text = [rng.randint(1, rng.choice([1, 2, 3, 50])) for _ in range(rng.randint(0, 120))] + [0]
    assert suffix.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def shingles(t):
    w = re.findall(SPACE, (t or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def linked_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return [(i, len(s), sets[find(n)][0]) for n, (i, s) in enumerate(sets)]


def test_jaccard(spark, texts):
    got = {tuple(-1 if v is None else v for v in r) for r in jaccard.components(frame(spark, texts)).collect()}
    assert got == set(linked_components(distinct_rows(texts)))
    assert jaccard.components(empty(spark)).collect() == []


@pytest.mark.parametrize("size", [4, 9, 14, 30, 120, 700])
def test_signatures_meet(size):
    """Any two sets at the similarity threshold share a signature."""
    import numpy as np

    rng = np.random.default_rng(size)
    for _ in range(60):
        union = rng.integers(0, 1 << 63, size * 2, dtype=np.uint64)
        core = union[: max(1, -(-4 * size // 5))]
        extra = size - len(core)
        cut = int(rng.integers(0, extra + 1))
        a, b = np.unique(np.concatenate((core, union[size : size + cut]))), np.unique(np.concatenate((core, union[size + cut : size + extra])))
        sig, owner = jaccard.signatures(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]))
        assert set(sig[owner == 0].tolist()) & set(sig[owner == 1].tolist())


def test_jaccard_stage(spark, texts):
    out = jaccard.representatives(frame(spark, texts))
    assert out.columns == [x.split()[0] for x in SCHEMA.split(", ")]
    best = {c for _, n, c in linked_components(distinct_rows(texts)) if n} | {i for i, n, _ in linked_components(distinct_rows(texts)) if not n}
    assert {-1 if r["doc_id"] is None else r["doc_id"] for r in out.collect()} == best


def test_token_counts(spark, texts):
    from tokenizers import Tokenizer

    rows = texts + [(900, "<|endoftext|>a<|endoftext|>"), (901, "it's 'll we'd\r\n\t x"), (902, "\0a\0")]
    tokenizer = Tokenizer.from_file(TOKENIZER)
    got = collections.Counter(tuple(r) for r in tokencount.token_counts(frame(spark, rows), TOKENIZER, 512).collect())
    want = collections.Counter()
    for i, t in rows:
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        want[i, len((t or "").encode()), n, n > 512] += 1
    assert got == want
    assert tokencount.token_counts(empty(spark), TOKENIZER).collect() == []


def test_token_count_fuzz():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    rng = random.Random(5)
    rows = ["".join(rng.choice("ab'srtvlemd  \n\t1,.!é日 ") for _ in range(rng.randrange(60))) for _ in range(800)]
    assert tokencount.count_tokens(rows, TOKENIZER).tolist() == [len(e.ids) for e in tokenizer.encode_batch(rows, add_special_tokens=False)]
    assert [packing.encoder(TOKENIZER)(t).tolist() for t in rows] == [e.ids for e in tokenizer.encode_batch(rows, add_special_tokens=False)]


def test_packing_round_trip(spark, texts):
    import numpy as np

    encode = packing.encoder(TOKENIZER)
    rows = [(i, t) for i, t in dict.fromkeys(texts)]
    pieces = packing.packed(frame(spark, rows), TOKENIZER, block_tokens=6000).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    for i, t in rows:
        ids = np.append(encode(t or ""), 1)
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p["start"]):
            assert (p["start"], p["doc_tokens"]) == (at, len(ids))
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].astype("<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= 2048 and at & (at - 1) == 0 and {p["tier"] for p in own} == {at}
    assert packing.packed(empty(spark), TOKENIZER).collect() == []


def test_fingerprints(spark, texts):
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(frame(spark, texts)).collect()}
    rows = distinct_rows(texts)
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        r = got[None if i < 0 else i]
        assert r["n_chars"] == len(t)
        if i not in (499, 500):  # a row that repeats is followed by itself
            changed = fingerprint.edited(t, after)
            assert r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
    assert len({got[200 + i]["fingerprint"] for i in range(5)}) == 1
    assert len(fingerprint.fingerprints(frame(spark, texts)).collect()) == len(texts)
    assert fingerprint.fingerprints(empty(spark)).collect() == []
    one = fingerprint.fingerprints(frame(spark, [(7, "only one here")])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_sketches():
    import numpy as np

    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 40_000, dtype=np.uint64) * np.uint64(2)
    a, b = fingerprint.Sketch.of(h[:30_000]), fingerprint.Sketch.of(h[20_000:])
    assert a.likeness(b) == pytest.approx(0.25, abs=0.03)
    small = fingerprint.Sketch.of(h[:400])
    assert small.containment(a) == pytest.approx(1.0)
    assert a.merged(b).text() == fingerprint.Sketch.of(h).text()
    assert fingerprint.Sketch.parse(a.text()).text() == a.text()


def labels_frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def labelled_corpus():
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(500):
        words = sentence(rng, rng.randrange(20, 90), 300).split()
        bad, rude = rng.random() < 0.4, rng.random() < 0.3
        if bad:
            words = [w + "!!" for w in words]
        if rude:
            for _ in range(rng.randrange(2, 6)):
                words.insert(rng.randrange(len(words)), rng.choice(["scum", "moron", "idiotic", "idiots"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(not bad), int(rude)))
    return rows, labels


def test_quality(spark):
    rows, labels = labelled_corpus()
    truth = {i: q for i, q, _ in labels}
    out = quality.scores(frame(spark, rows + [(900, None), (None, "x")]), labels_frame(spark, labels)).collect()
    assert len(out) == len(rows) + 2
    for r in out:
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.95
    assert quality.scores(empty(spark), labels_frame(spark, [])).collect() == []
    none = quality.scores(frame(spark, rows[:3]), labels_frame(spark, [])).collect()
    assert len({r["score"] for r in none}) == 1


def test_toxicity(spark):
    rows, labels = labelled_corpus()
    truth = {i: x for i, _, x in labels}
    docs = frame(spark, rows + [(900, None), (901, "...")])
    out = toxicity.scores(docs, labels_frame(spark, labels)).collect()
    held = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.95
    text = dict(rows)
    spotted = [text[r["doc_id"]][s["start"] : s["end"]] for r in out if r["predicted"] and r["doc_id"] in text for s in r["spans"]]
    assert spotted and sum(bool(re.search("scum|moron|idiot", s)) for s in spotted) / len(spotted) > 0.9
    kept = toxicity.accepted(docs, labels_frame(spark, labels))
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in out if not r["predicted"]}
    assert toxicity.scores(empty(spark), labels_frame(spark, [])).collect() == []


def test_field_marginals():
    """The scan over runs against the plain recursion."""
    import numpy as np

    rng = np.random.default_rng(4)
    n = 700
    e, trans, start = rng.normal(0, 2, n), rng.normal(0, 1, (2, 2)), 0.3
    first = np.zeros(n, bool)
    first[[0, 5, 300, 301]] = True
    got, _ = toxicity.marginals(e, first, trans, start)
    ends = np.append(np.flatnonzero(first)[1:], n)
    for a, b in zip(np.flatnonzero(first), ends, strict=True):
        score = np.array([[0.0, x] for x in e[a:b]])
        alpha = np.zeros((b - a, 2))
        beta = np.zeros((b - a, 2))
        alpha[0] = np.array([0.0, start]) + score[0]
        for i in range(1, b - a):
            alpha[i] = [np.logaddexp(alpha[i - 1][0] + trans[0, j], alpha[i - 1][1] + trans[1, j]) + score[i][j] for j in (0, 1)]
        for i in range(b - a - 2, -1, -1):
            beta[i] = [np.logaddexp(trans[j, 0] + score[i + 1][0] + beta[i + 1][0], trans[j, 1] + score[i + 1][1] + beta[i + 1][1]) for j in (0, 1)]
        z = alpha + beta
        assert np.allclose(got[a:b], 1 / (1 + np.exp(z[:, 0] - z[:, 1])), atol=1e-9)


ITEM = "Tom drives 40 km to the old market and then buys 12 apples for his brother Peter before he walks home again slowly"


def test_decontamination(spark):
    rng = random.Random(2)
    bench = spark.createDataFrame([(1, ITEM), (2, "tiny item"), (3, None), (4, sentence(rng, 30, 9000))], "item_id bigint, text string")
    other = ITEM.replace("40 km", "75 miles").replace("12", "9")
    mixed = "a river of 3 boats and 3 ships then passes 7 old towers with many small green lights on them all night long"
    rows = [
        (1, "before it " + ITEM + " after it"), (2, "said he, " + other + " and so on"), (3, sentence(rng, 300, 9000)), (4, None), (5, ""), (6, ITEM.upper()), (7, "Tom drives 40 km to the old market"), (8, mixed.replace("3 ships", "4 ships")),
    ]
    docs = frame(spark, rows)
    got = {(r["doc_id"], r["item_id"], r["verbatim"]) for r in decontam.matches(docs, bench.unionAll(spark.createDataFrame([(9, mixed)], bench.schema))).collect()}
    assert {(1, 1, True), (2, 1, False)} <= got
    assert not any(d in (3, 4, 5, 7) for d, _, _ in got)
    assert (8, 9, False) not in got  # equal fillers must stay equal
    kept = decontam.clean(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} >= {3, 4, 5, 7, 8}
    assert not {1, 2} & {r["doc_id"] for r in kept.collect()}
    assert decontam.matches(empty(spark), bench).collect() == [] and decontam.matches(docs, bench.limit(0)).collect() == []


TRAIN = "A train travels 120 km in 2 hours and then 90 km in 3 hours. What is its average speed in km per hour?"


def found(spark, items, texts):
    """(doc_id, item_id, verbatim) of the matches; ids are places in the lists."""
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    return {(r["doc_id"], r["item_id"], r["verbatim"]) for r in decontam.matches(frame(spark, list(enumerate(texts))), bench).collect()}


def filler(n):
    return "".join(f"filler{i} " for i in range(n))


def test_decontamination_of_slots(spark):
    numbers = "Go on: 3, 5, 8, 12, 17, 23, 30, 38, 47, 57, 68, 80, 93"
    texts = [filler(n) + TRAIN + " the end of it" for n in range(12)] + [TRAIN.replace("120", "150").replace("90 km", "70 km")]
    texts += ["we " + numbers.lower() + " and more numbers", " ".join(str(i * i) for i in range(100, 140))]
    got = found(spark, [TRAIN, numbers], texts)
    assert got == {(n, 0, True) for n in range(12)} | {(12, 0, False), (13, 1, True)}


@pytest.mark.parametrize("n", [1, 2, 4, 5, 6, 7, 10, 13, 24])
def test_decontamination_at_each_offset(spark, n):
    item = " ".join(f"w{i}x" for i in range(n))
    texts = [filler(k) + item + " the end" for k in range(6)] + [filler(9), item.upper(), "", None]
    assert found(spark, [item, "", None], texts) == {(k, 0, True) for k in (0, 1, 2, 3, 4, 5, 7)}


def test_decontamination_of_passages(spark):
    items = [[f"w{n}x{i}" for i in range(n)] for n in (40, 59, 100)]
    passage = [(16, 0), (20, 1), (40, 2)]
    texts = [filler(k) + " ".join(items[i][5 : 5 + n]) + " the end" for n, i in passage for k in range(3)]
    texts += [filler(3) + " ".join(items[1][a:b] + ["put", "in"] + items[1][b:c]) for a, b, c in ((5, 17, 29), (8, 15, 22))]
    texts += [filler(3) + " ".join(items[2][5:17]), filler(2) + " ".join(items[2][5:15]) + " " + filler(40) + " ".join(items[2][15:25])]
    got = found(spark, [" ".join(x) for x in items], texts)
    assert got == {(3 * j + k, i, True) for j, (_, i) in enumerate(passage) for k in range(3)} | {(9, 1, True), (10, 1, True)}


def test_url_filter(spark):
    urls = [
        (1, "http://A.Example.NET/en/1?x#y", "a.example.net", "/en/1", "example.net/en/", "allow"),
        (2, "https://x.net/", "x.net", "/", "net/", "block"),
        (3, "https://x.net", "x.net", "", None, None),
        (4, "http://notexample.com/de/1", "notexample.com", "/de/1", None, None),
        (5, "http://m.example.com/de/1", "m.example.com", "/de/1", "example.com/de/", "block"),
        (6, "ftp://b.org/fr/#", "b.org", "/fr/", "org/fr/", "allow"),
        (7, None, "", "", None, None),
        (8, "no scheme", "", "", None, None),
        (9, "http://internet/", "internet", "/", None, None),
        (9, "http://internet/", "internet", "/", None, None),
        (10, "http://q.com?a=://b/c", "q.com", "", None, None),
    ]
    pages = spark.createDataFrame([(i, u, "h", "z", "z") for i, u, *_ in urls], "page_id bigint, url string, html string, host string, template string")
    got = url_filter.judged(pages).collect()
    assert len(got) == len(urls)
    found = {r["page_id"]: r for r in got}
    for i, _, host, path, rule, verdict in urls:
        r = found[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] in ("allow", "block") and (verdict is None or r["verdict"] == verdict)
    assert url_filter.judged(pages.limit(0)).collect() == []


def test_url_templates_generalise(spark):
    rows = [(i, f"http://bad.test/item/{i}", "x") for i in range(60)] + [(1000 + i, f"http://good.test/read/{i}", "x") for i in range(60)]
    rows += [(2000 + i, f"http://bad.test/item/x/{i}", "x") for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r["page_id"]: r for r in url_filter.judged(pages, {"bad.test/item/1": "block", "bad.test/item/2": "block", "good.test/read/1": "allow"}).collect()}
    assert got[35]["template"] == got[7]["template"] and got[35]["verdict"] == "block"
    assert got[1035]["verdict"] == "allow"


def test_pipeline_stages(spark, texts, tmp_path):
    import corpus_pipeline

    docs = frame(spark, texts)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels_frame(spark, [(i, 1, 0) for i in range(20)] + [(100, 1, 1)]).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, ITEM)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "jaccard_join", "suffix_array_dedup", "decontamination", "packing"]
    rows = docs
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, rows, str(tmp_path)).write.parquet(str(tmp_path / f"out{n}"))
        rows = spark.read.parquet(str(tmp_path / f"out{n}"))
        if n < 4:
            assert rows.columns == docs.columns, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == rows.count()


def test_queries_are_registered():
    from quern.llm import queries

    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.queries() if n.startswith("op")) == list(range(1, 11))
