"""Brute-force versions of trees, likeness and windows; hot keys, clashing names, repeats, ties and very long texts."""

from __future__ import annotations

import collections
import math
import pathlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quern.llm import decontam, fingerprint, folds, jaccard, packing, quality, repeats, substring, suffix, tokencount, toxicity, url_filter
from tests.llm.test_corpus import TOKENIZER, labelled_corpus, labels_frame, sentence

CLASHING = ["__id", "__th", "__z", "__spans", "__null", "__hit", "hit", "c0", "C1", "__salt", "shard", "key", "score", "n", "w", "h", "a.b", "tier"]


def clashing(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for i, c in enumerate(CLASHING):
        df = df.withColumn(c, F.lit(f"v{i}"))
    return df.withColumn("n_chars", F.lit(0).cast("bigint")).repartition(3)


def mixed_rows():
    rng = random.Random(8)
    base = sentence(rng, 120, 6000)
    rows = [(i, base) for i in range(4)] + [(10 + i, sentence(rng, 60, 6000)) for i in range(6)]
    return rows + [(20, None), (21, ""), (None, base), (10, rows[4][1]), (30, sentence(rng, 40, 6000) + " " + base[:600])]


def test_names_that_clash(spark):
    docs = clashing(spark, mixed_rows())
    labels = labels_frame(spark, [(i, 1, 0) for i in range(10)] + [(11, 0, 1)])
    bench = spark.createDataFrame([(1, "some words that no document of these holds at all in any place")], "item_id bigint, text string")
    for out in (jaccard.representatives(docs), suffix.deduplicated(docs), decontam.clean(docs, bench), toxicity.accepted(docs, labels)):
        assert out.columns == docs.columns
        for r in out.collect():
            assert [r[c] for c in CLASHING] == [f"v{i}" for i in range(len(CLASHING))]
    for out in (jaccard.components(docs), substring.removals(docs), suffix.removals(docs), fingerprint.fingerprints(docs), packing.packed(docs, TOKENIZER), tokencount.token_counts(docs, TOKENIZER), quality.scores(docs, labels), toxicity.scores(docs, labels)):
        assert out.count() >= len(mixed_rows())


def test_one_row_of_an_id_and_text_stays(spark):
    docs = clashing(spark, mixed_rows())
    out = sorted((-1 if r["doc_id"] is None else r["doc_id"]) for r in jaccard.representatives(docs).collect())
    assert out == [-1, *range(10, 16), 20, 21, 30] and jaccard.representatives(docs.limit(0)).count() == 0


def near_misses(n):
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    for i in range(n):
        at = rng.randrange(300)
        yield i, " ".join(base[:at] + [f"x{i}y{k}" for k in range(40)] + base[at + 40 :])


def test_near_misses_make_no_pairs(spark, monkeypatch):
    """Rows between the steps grow with the number of near misses, not with its square."""
    most = {}
    plain = jaccard.written
    for n in (40, 160):
        counts = []

        def spy(df, counts=counts):
            out = plain(df)
            if {"a", "b"} <= set(out.columns) or {"low", "high"} == set(out.columns):
                counts.append(out.count())
            return out

        monkeypatch.setattr(jaccard, "written", spy)
        rows = list(near_misses(n))
        got = {r["doc_id"]: r["component_id"] for r in jaccard.components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
        most[n] = max(counts)
        sets = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in (t.split() for _, t in rows)]
        root = list(range(n))
        for a in range(n):
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    p, q = root[a], root[b]
                    root = [min(p, q) if r in (p, q) else r for r in root]
        assert got == dict(enumerate(root))
    assert most[160] < 8 * most[40] and most[160] < 160 * 159 / 2 / 4


def test_groups_are_split(spark, monkeypatch):
    """The same components when every group is dealt over parts and blocks."""
    rows = list(near_misses(40)) + [(100 + i, f"{t} {' '.join(f'z{i}q{k}' for k in range(8))}") for i, (_, t) in enumerate(near_misses(10))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = sorted(map(tuple, jaccard.components(docs).collect()))
    monkeypatch.setattr(jaccard, "WHOLE_GROUP", 3)
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(jaccard, "SHARD_BYTES", 8000)
    monkeypatch.setattr(jaccard, "HOME_BYTES", 3000)
    assert sorted(map(tuple, jaccard.components(docs).collect())) == want


def shuffled(spark):
    """Bytes that all stages so far have shuffled."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    none = sc._jvm.java.util.ArrayList()
    stages = sc._jsc.sc().statusStore().stageList(none, False, False, sc._gateway.new_array(sc._jvm.double, 0), none)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_open_groups_move_a_set_once(spark, monkeypatch):
    """Many groups of the same sets don't move their parities and elements again and again."""
    rows = list(near_misses(120))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr(jaccard, "SHARD_ROWS", 1 << 8)
    groups = []
    plain = jaccard._candidates
    monkeypatch.setattr(jaccard, "_candidates", lambda *a: groups.append(plain(*a)) or groups[0])
    before = shuffled(spark)
    jaccard.components(docs).collect()
    moved = shuffled(spark) - before
    members = groups[0].count()
    assert moved < 170 * members  # 208 when each membership took its set's parities along, 131 since


def test_texts_that_nothing_is_compared_with_stay(spark, monkeypatch):
    """Only documents whose elements are asked for are compressed and shuffled."""
    rng = random.Random(12)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(200))) for i in range(400)]
    rows += [(1000 + i, f"{rows[i][1]} more{i}") for i in range(3)]
    counts = []
    plain = jaccard.compressed

    def spy(*args):
        out = plain(*args)
        counts.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "compressed", spy)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: i % 1000 for i, _ in rows}
    assert counts and 6 <= max(counts) < 40


def test_sieve(spark):
    rows = spark.range(20000).select(F.col("id").alias("__id"), F.xxhash64(F.col("id").cast("string")).alias("__th"))
    sieve = repeats.Sieve(rows.where("__id < 2000"))
    spots = rows.select("__id", sieve.spot(F.col("__id"), F.col("__th")).alias("spot")).orderBy("__id").toPandas()["spot"].to_numpy()
    passed = sieve.passes(spots)
    assert passed[:2000].all() and passed[2000:].mean() < 0.1
    assert not repeats.Sieve(rows.limit(0)).passes(spots).any()


def test_shuffle_files_go_with_the_step(spark):
    folders = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())

    def files():
        return {f for d in folders for f in pathlib.Path(d).rglob("shuffle_*.data")}

    before = files()
    out = jaccard.written(spark.range(1000).repartition(7).groupBy((F.col("id") % 10).alias("k")).count())
    assert out.count() == 10 and not {f for f in files() - before if f.stat().st_size > 500}
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_likeness_against_exact_sets(spark):
    rng = random.Random(21)
    base = [f"w{rng.randrange(5000)}" for _ in range(3000)]
    rows = []
    for i in range(120):
        n = rng.choice([3, 8, 30, 100, 200, 500, 1500])
        own = list(base[:n])
        for _ in range(rng.randrange(0, 1 + n // 8)):
            own[rng.randrange(n)] = f"v{rng.randrange(9999)}"
        rows.append((i, " ".join(own)))
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}

    def shingles(t):
        w = t.split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    errors = []
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        for other, name in ((fingerprint.edited(t, after), "near_edited"), (after, "near_next")):
            a, b = shingles(t), shingles(other)
            errors.append(got[i][name] - len(a & b) / len(a | b))
    assert abs(sum(errors)) / len(errors) < 0.01 and sum(map(abs, errors)) / len(errors) < 0.03 and max(map(abs, errors)) < 0.25


@pytest.mark.parametrize("n", [1, 127, 128, 255, 256, 4000])
def test_sketch_is_a_threshold(n):
    """What is kept depends on the number of shingles and each hash alone."""
    import numpy as np

    h = np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
    s = fingerprint.Sketch.of(h)
    assert s.bound == (1 << 40) // (1 if n < 128 else 2 if n < 256 else 4)
    assert s.kept.tolist() == sorted(x >> 24 for x in h.tolist() if x >> 24 < s.bound)


def test_hot_id_in_runs(spark):
    rng = random.Random(6)
    rows = [(7, sentence(rng, 12, 900)) for _ in range(60)] + [(i, sentence(rng, 12, 900)) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    runs = fingerprint.in_order(docs).where("not echo").groupBy("run").count().collect()
    assert sum(r["count"] for r in runs) == 90 and max(r["count"] for r in runs) < 60
    order = docs.select("doc_id", F.xxhash64("text").alias("th"), "text").orderBy("doc_id", "th").collect()
    got = collections.Counter((r["doc_id"], r["edited_sha256"]) for r in fingerprint.fingerprints(docs).collect())
    want = collections.Counter()
    for a, b in zip(order, order[1:] + order[:1], strict=True):
        import hashlib

        want[a["doc_id"], hashlib.sha256(fingerprint.edited(a["text"], b["text"]).encode()).hexdigest()] += 1
    assert got == want


def test_step_groups_are_even():
    rng = random.Random(1)
    block = packing.Block()
    for i in range(1500):
        block.add(i, rng.choice([rng.randrange(1, 300), rng.randrange(1, 3000), rng.randrange(1, 9000)]))
    windows = block.pack()
    groups = packing.step_groups(windows, packing.STEP_TOKENS)
    by_group = collections.defaultdict(list)
    for w, g in zip(windows, groups, strict=True):
        by_group[g].append(w)
    tiers = collections.defaultdict(list)
    for own in by_group.values():
        sizes = {sum(n for _, _, n in w) for w in own}
        assert len(sizes) == 1
        size = sizes.pop()
        assert len(own) * size <= max(size, packing.STEP_TOKENS)
        tiers[size].append((len(own), sum(n * n for w in own for _, _, n in w), max(sum(n * n for _, _, n in w) for w in own)))
    for own in tiers.values():
        counts = [c for c, _, _ in own]
        assert max(counts) - min(counts) <= 1
        for c in set(counts):
            costs = [x for k, x, _ in own if k == c]
            assert max(costs) - min(costs) <= max(m for _, _, m in own)


def test_leftovers_are_routed():
    block = packing.Block()
    for i, n in enumerate((5000, 2048, 1500, 700, 300, 100, 256)):
        block.add(i, n)
    assert {t: [p[0] for p in ps] for t, ps in block.routed.items()} == {2048: [1500], 1024: [904, 700], 512: [300], 256: [100, 256]}


def tree(counts):
    """Templates of (host, path): (n, bad, good), by the rules of the tree."""
    parts = {k: [x for x in k[1].split("/") if x] for k in counts}
    out = dict.fromkeys(counts, "")

    def symbol(x):
        return "*" if re.search(url_filter.VARIABLE, re.sub(r"\.[A-Za-z]{1,5}$", "", x)) else x

    for level in range(url_filter.LEVELS):
        last = level == url_filter.LEVELS - 1
        seg = {k: "/".join(map(symbol, p[level:])) if last else symbol(p[level]) for k, p in parts.items() if len(p) > level}
        nodes = collections.defaultdict(lambda: collections.defaultdict(lambda: [0, 0, 0]))
        for k, s in seg.items():
            for i in range(3):
                nodes[k[0], out[k]][s][i] += counts[k][i]
        names = {}
        for node, branches in nodes.items():
            total = sum(b[0] for b in branches.values())
            kind = {s: "*" if s == "*" or b[0] < url_filter.LEAST or b[0] < url_filter.RARE * total else s for s, b in branches.items()}
            pooled = collections.defaultdict(lambda: [0, 0])
            for s, b in branches.items():
                pooled[kind[s]][0] += b[1]
                pooled[kind[s]][1] += b[2]
            order = sorted((b / (b + g), s, b, g) for s, (b, g) in pooled.items() if b + g)
            groups = []
            for rate, s, b, g in order:
                if groups:
                    ob, on, segs = groups[-1]
                    p, gap = (ob + b) / (on + b + g), rate - ob / on
                    if gap == 0 or gap * gap < url_filter.Z**2 * p * (1 - p) * (1 / on + 1 / (b + g)):
                        groups[-1] = (ob + b, on + b + g, [*segs, s])
                        continue
                groups.append((b, b + g, [s]))
            name = {}
            for _, _, segs in groups:
                for s in segs:
                    name[s] = "*" if "*" in segs else "{" + "|".join(sorted(segs)) + "}" if len(segs) > 1 else s
            for s in branches:
                names[node, s] = name.get(kind[s], kind[s])
        for k, s in seg.items():
            out[k] = out[k] + "/" + names[(k[0], out[k]), s]
    return out


@pytest.mark.parametrize("hot", [1000, 3])
def test_url_tree_against_brute_force(spark, monkeypatch, hot):
    rng = random.Random(12)
    hosts = ["a.net", "b.example.com", "c.example.net", "d.org"]
    rows = []
    for i in range(900):
        host = rng.choice([hosts[0], *hosts])
        depth = rng.choice([0, 1, 2, 3, 9])
        path = "".join("/" + rng.choice(["de", "en", "fr", "x", str(rng.randrange(99)), f"slug{rng.randrange(5)}"]) for _ in range(depth))
        rows.append((i, f"http://{host}{path}{'?q' if i % 7 == 0 else ''}"))
    rows += [(1000 + i, "http://hot.net/de/same") for i in range(300)] + [(2000 + i, None) for i in range(50)]
    monkeypatch.setattr(url_filter, "HOT", hot)
    monkeypatch.setattr(url_filter, "HOT_ROWS", 1000 if hot == 1000 else 20)
    got = url_filter.judged(spark.createDataFrame(rows, "page_id bigint, url string").repartition(3)).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == dict.fromkeys(["page_id", "host", "path", "rule", "verdict", "template", "purity"]).keys()
    counts = collections.defaultdict(lambda: [0, 0, 0])
    for r in got:
        own = counts[r["host"], r["path"]]
        own[0] += 1
        if r["rule"]:
            own[1 if url_filter.RULES[r["rule"]] == "block" else 2] += 1
    names = tree(counts)
    leaf, site, whole = collections.defaultdict(lambda: [0, 0]), collections.defaultdict(lambda: [0, 0]), [0, 0]
    for k, (_, b, g) in counts.items():
        for own in (leaf[k[0], names[k]], site[k[0]], whole):
            own[0] += b
            own[1] += g
    prior = whole[0] / max(1, sum(whole))
    for r in got:
        k = r["host"], r["path"]
        assert r["template"] == names[k]
        b, g = leaf[k[0], names[k]]
        rate = (site[k[0]][0] + url_filter.WEIGHT * prior) / (sum(site[k[0]]) + url_filter.WEIGHT)
        purity = (b + url_filter.WEIGHT * rate) / (b + g + url_filter.WEIGHT) if b + g else None
        assert (r["purity"] is None) == (purity is None) and (purity is None or math.isclose(r["purity"], purity))
        want = url_filter.RULES[r["rule"]] if r["rule"] else "block" if purity is not None and purity >= url_filter.PURITY else "allow"
        assert r["verdict"] == want




def decontam_words(t):
    """The canonical words by plain Python."""
    import re as r

    t = (t or "").replace("\u0001", " ")
    number = r"\d+(?:[.,]\d+)*"
    t = r.sub(rf"(?<![^\W_])[$€£]?({number})(?:\s?({decontam.UNITS}|%))?(?![^\W_])", lambda m: f"\u0001n{m[1]} \u0001u{m[2] or ''} ", t)
    t = r.sub(r"(?<=[^\W_] |[,;:] )([A-ZÄÖÜÉ][a-zäöüéß]+)(?![^\W_])", "\u0001p\\1", t)
    out = [x for x in r.split(r"(?:[^\w\u0001.,]|_|(?<!\d)[.,]|[.,](?!\d))+", t.lower()) if x]
    return [x for x in out if x != "\u0001u"]


def plain_matches(docs, items):
    """Pairs by the rules, window by window."""
    cut = lambda w: [x[:2] if x.startswith("\u0001") else x for x in w]
    hits = set()
    for i, item in items:
        b = decontam_words(item)
        if not b:
            continue
        n = min(len(b), decontam.WINDOW)
        for d, text in docs:
            w = decontam_words(text)
            found = [(x, y) for x in range(len(w) - n + 1) for y in range(len(b) - n + 1) if cut(w[x : x + n]) == cut(b[y : y + n])]
            groups = collections.defaultdict(list)
            for x, y in found:
                groups["d", x - y].append((x, y))
                for k in (0, 1):
                    groups["b", (x - y) // decontam.BAND + k].append((x, y))
            for own in groups.values():
                covers = [sorted({p + k for p in side for k in range(n)}) for side in ({x for x, _ in own}, {y for _, y in own})]
                covered = min(map(len, covers))

                def longest(c):
                    best = run = 1
                    for p, q in zip(c, c[1:]):
                        run = run + 1 if q == p + 1 else 1
                        best = max(best, run)
                    return best

                run = min(longest(covers[1]), covered)
                slots = {(b[y + k], w[x + k]) for x, y in own for k in range(n) if b[y + k].startswith("\u0001")}
                if len({s for s, _ in slots}) != len(slots) or len({s for _, s in slots}) != len(slots):
                    continue
                literals = len({y + k for _, y in own for k in range(n) if not b[y + k].startswith("\u0001")})
                enough = covered >= max(decontam.LEAST_WORDS, math.ceil(len(b) * decontam.SHARE)) or run >= decontam.RUN
                short = len(b) < decontam.LEAST_WORDS + decontam.SLACK and covered + decontam.SLACK >= len(b)
                verbatim = all(s == t for s, t in slots)
                if (enough or short) and (verbatim or literals >= decontam.LITERALS):
                    hits.add((d, i))
    return hits


NAMES = ["Tom", "Maria", "Peter", "Anna", "Karim", "Lucy"]
TEMPLATES = [
    "Yesterday {0} bought {a} kg of rice and {b} apples at the old market near the river, then {0} gave {c} of them to {1} and walked home",
    "A train leaves the station with {a} people, after {b} minutes another {c} people get on, and {0} asks how many people are on the train now",
    "In the garden of {0} there are {a} rows with {b} trees each, and {1} cuts down {c} of the trees before the winter comes again",
    "For the party {0} needs {a} cups that cost {b} dollars each, but {1} has only {c} dollars left so how many can they buy together",
]


def filled(rng, template, pool):
    a, b, c = rng.sample(range(2, 99), 3)
    x, y = rng.sample(pool, 2)
    return template.format(x, y, a=a, b=b, c=c)


def test_decontamination_against_brute_force(spark):
    """Re-parameterised, halved and verbatim questions between other words: the pairs of the plain version, and nearly all that were planted."""
    rng = random.Random(17)
    items = [(i, filled(rng, TEMPLATES[i % 4], NAMES[:3])) for i in range(12)] + [(50 + i, sentence(rng, 30, 9000)) for i in range(8)]
    docs, planted = [], set()
    for k in range(60):
        before, after = sentence(rng, rng.randrange(0, 60), 9000), sentence(rng, rng.randrange(0, 60), 9000)
        i, item = rng.choice(items)
        if i < 50 and k % 3:
            item = filled(rng, TEMPLATES[i % 4], NAMES[3:])
            planted |= {(k, j) for j, _ in items[:12] if j % 4 == i % 4}
        elif k % 3 == 0:
            half = item.split()
            item = " ".join(half[: (len(half) + 3) // 2]) if k % 2 else item
            planted.add((k, i))
        docs.append((k, f"{before} well, {item} {after}"))
    docs += [(100 + k, sentence(rng, 200, 9000)) for k in range(20)] + [(200, None), (201, ""), (0, "again row of an id")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    got = {(r["doc_id"], r["item_id"]) for r in decontam.matches(frame, bench).collect()}
    want = plain_matches([d for d in docs if d != docs[-1]], items)
    assert got == want
    assert len(planted & got) / len(planted) >= 0.9 and not any(d >= 100 for d, _ in got)
    repeated = decontam.matches(frame.unionAll(frame), bench.unionAll(bench))
    assert {(r["doc_id"], r["item_id"]) for r in repeated.collect()} == got


def test_repeated_rows_score_alike(spark):
    rows, labels = labelled_corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for module, name in ((quality, "quality"), (toxicity, "toxic")):
        once = {r["doc_id"]: r["score"] for r in module.scores(docs, labels_frame(spark, labels)).collect()}
        twice = module.scores(docs.unionAll(docs), labels_frame(spark, labels + labels)).collect()
        assert len(twice) == 2 * len(rows) and all(math.isclose(r["score"], once[r["doc_id"]]) for r in twice), name


def test_sample_is_bounded(spark):
    rows = [(i, "word " * 200) for i in range(200)] + [(5, "another text of an id")]
    docs, labels = spark.createDataFrame(rows, "doc_id bigint, text string"), labels_frame(spark, [(i, i % 2, 0) for i in range(200)])
    out = folds.labelled_sample(docs, labels, "quality", 5, 0, 50).collect()
    assert len(out) == 50 == len({r["doc_id"] for r in out})
    few = folds.labelled_sample(docs, labels, "quality", 5, 0, 50, most_bytes=5000).collect()
    assert 0 < len(few) <= 6 and all(r["text"] == "word " * 200 or r["doc_id"] == 5 for r in few)


def test_few_labels_of_one_class(spark):
    rows, labels = labelled_corpus()
    one_bad = [(i, int(i != 7), 0) for i, _, _ in labels[:40]]
    out = quality.scores(spark.createDataFrame(rows, "doc_id bigint, text string"), labels_frame(spark, one_bad)).collect()
    assert len({round(r["score"], 9) for r in out}) > 10


def test_very_long_texts(spark):
    rng = random.Random(3)
    long = sentence(rng, 250_000, 40_000)
    rows = [(1, long), (2, long[: len(long) // 2]), (3, sentence(rng, 40, 900)), (4, "x" * 1_200_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = labels_frame(spark, [(1, 1, 0), (3, 0, 1)])
    assert {r["doc_id"]: r["component_id"] for r in jaccard.components(docs).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}
    assert {r["doc_id"]: r["n_removed"] > 100_000 for r in substring.removals(docs).collect()} == {1: False, 2: True, 3: False, 4: False}
    gone = {r["doc_id"]: r["n_removed"] for r in suffix.removals(docs).collect()}
    assert gone[2] == len(rows[1][1].encode()) and gone[1] >= gone[2] and gone[3] == 0 and gone[4] == 1_200_000
    prints = {r["doc_id"]: r for r in fingerprint.fingerprints(docs).collect()}
    assert prints[1]["near_next"] == pytest.approx(0.5, abs=0.03)
    assert {r["doc_id"] for r in quality.scores(docs, labels).collect()} == {r["doc_id"] for r in toxicity.scores(docs, labels).collect()} == {1, 2, 3, 4}
    bench = spark.createDataFrame([(1, " ".join(long.split()[-30:]))], "item_id bigint, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontam.matches(docs, bench).collect()] == [(1, 1)]
    short = docs.where("doc_id < 4")
    pieces = packing.packed(short, TOKENIZER).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
    counted = {r["doc_id"]: r["n_tokens"] for r in tokencount.token_counts(short, TOKENIZER).collect()}
    assert all(r["n"] == r["all"] == counted[r["doc_id"]] + 1 for r in pieces)


def test_quality_query_against_plain_sums(spark, tmp_path):
    """Scores of the query, from its model, by plain sums over each text's n-grams."""
    import numpy as np
    import pyarrow as pa

    from quern.llm import queries
    from quern.llm.arrow import texts

    rows, labels = labelled_corpus()
    rows += [(900, None), (901, ""), (902, "a"), rows[3]]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    labels_frame(spark, labels).write.parquet(str(tmp_path / "labels.parquet"))
    docs, marks = (spark.read.parquet(str(tmp_path / f"{n}.parquet")) for n in ("documents", "labels"))
    model = quality.train(docs, marks, 5, 0).astype(float)
    weights, ratios = model[: quality.BUCKETS], model[quality.BUCKETS : 2 * quality.BUCKETS]
    bias, slope, level = model[-3:]
    want = collections.defaultdict(list)
    for i, t in rows:
        found = set(next(quality.Indicators().of(texts(pa.array([t or ""], pa.large_string())))).tolist())
        length = math.sqrt(sum(ratios[k] ** 2 for k in found)) or 1
        margin = sum(weights[k] * ratios[k] for k in found) / length + bias
        want[i].append(1 / (1 + np.exp(-(slope * margin + level))))
    got = queries.op2_quality(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert math.isclose(r["score"], want[r["doc_id"]][0], rel_tol=1e-6) and r["predicted"] == int(r["score"] >= 0.3)


def test_toxicity_query_against_plain_recursion(spark, tmp_path):
    """Scores of the query, from its model, by the plain forward-backward recursion over each text's tokens."""
    import numpy as np
    import pyarrow as pa

    from quern.llm import queries
    from quern.llm.arrow import texts

    rows, labels = labelled_corpus()
    rows = rows[:200] + [(900, None), (901, "..."), (902, "scum"), rows[3]]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    labels_frame(spark, labels).write.parquet(str(tmp_path / "labels.parquet"))
    docs, marks = (spark.read.parquet(str(tmp_path / f"{n}.parquet")) for n in ("documents", "labels"))
    values = toxicity.train(docs, marks, 3, 1).values.astype("<f4").astype(float)
    trans, start = values[toxicity.BUCKETS : toxicity.BUCKETS + 4].reshape(2, 2), values[toxicity.BUCKETS + 4]
    got = {r["doc_id"]: r for r in queries.op4_toxicity(spark, str(tmp_path)).collect()}
    for i, t in rows:
        own = texts(pa.array([t or ""], pa.large_string()))
        f = toxicity.features(own, toxicity.tokens(own))
        n = f.shape[1]
        assert n == len(re.findall(rb"[0-9A-Za-z\x80-\xff]+", (t or "").encode()))
        score = [(0.0, sum(values[b] for b in f[:, k])) for k in range(n)]
        alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
        for k in range(n):
            for s in (0, 1):
                alpha[k, s] = score[k][s] + ((start if s else 0.0) if k == 0 else np.logaddexp(alpha[k - 1, 0] + trans[0, s], alpha[k - 1, 1] + trans[1, s]))
        for k in range(n - 2, -1, -1):
            for s in (0, 1):
                beta[k, s] = np.logaddexp(*(trans[s, u] + score[k + 1][u] + beta[k + 1, u] for u in (0, 1)))
        z = alpha + beta
        p = 1 / (1 + np.exp(z[:, 0] - z[:, 1])) if n else np.zeros(0)
        expected, high = p.sum() + 1e-3, min(max(p.max(initial=0), 1e-6), 1 - 1e-6)
        evidence = (math.log(expected), math.log(expected / (n + toxicity.PRIOR_TOKENS)), math.log(high / (1 - high)), 1.0)
        want = 1 / (1 + math.exp(-sum(a * b for a, b in zip(evidence, values[-toxicity.EVIDENCE :], strict=True))))
        assert math.isclose(got[i]["score"], want, rel_tol=1e-4, abs_tol=1e-6), i
        assert got[i]["predicted"] == int(got[i]["score"] >= 0.7)
