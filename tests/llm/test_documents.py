"""Operators on documents: the driver's tables against SQL, and difficult rows against plain Python."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F
from rankframe.llm import byte_bpe, decontaminate, line_dedup, near_dup, quality
from rankframe.llm.oracle import ORACLE
from rankframe.llm.queries import QUERIES

from checks.compare import tables_in

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, name):
    df = QUERIES[name](spark, SF)
    got = sorted(map(tuple, df.select(*sorted(df.columns)).collect()))
    result = tables_in(SF).execute(ORACLE[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(row[columns.index(c)] for c in sorted(columns)) for row in result.fetchall())
    assert got == want and got


LONG = "\n".join(f"word{i} and more of line {i % 700}" for i in range(3000))
TEXTS = [None, "", " \t\n", "One", "ÀÉ İ ß Ⅷ a-b", "same line\nother\nsame line\n", LONG, LONG, "\n\n\n", "x" * 20000, "a\r\nb\x0bc d\x1ce"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, ties, repeated rows, and columns named as operators name theirs."""
    rows = [(i if i % 4 else None, t, f"h{i % 2}" if i % 3 else None, "own", -1, "w", 7) for i, t in enumerate(TEXTS)]
    rows += [(50 + i, f"same line\nother {i}", "h1", "own", -1, "w", 7) for i in range(12)] + [(50, "same line\nother 0", "h1", "own", -1, "w", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, kept string, n_words long, word string, h1 long")


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def lines_by_hand(texts, min_docs):
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    key = lambda line: line.translate(lower).strip(" \t\n\x0b\x0c\r")
    seen = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")})
    drop = {k for k, n in seen.items() if k and n >= min_docs}
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        left = [x for x in lines if key(x) not in drop]
        out.append((len(lines), len(lines) - len(left), "\n".join(left) if len(left) < len(lines) else t))
    return out


def test_line_dedup_odd_rows(spark, odd, none):
    made = line_dedup.drop_frequent_lines(odd, min_docs=10)
    assert made.columns == [*odd.columns, "n_lines", "n_dropped"]
    got = Counter((r["n_lines"], r["n_dropped"], r["text"]) for r in made.collect())
    assert got == Counter(lines_by_hand([r["text"] for r in odd.collect()], 10))
    assert line_dedup.drop_frequent_lines(none).count() == 0


def base_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    at = defaultdict(list)
    for i in range(len(words) - 2):
        at[tuple(words[i : i + 3])].append(i)
    repeated = {p + k for places in at.values() if len(places) > 1 for p in places for k in range(3)}
    solid = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, len(solid) - len(set(solid)), len(repeated)


def depleted_by_hand(rows, min_docs=10, percent=30):
    """rows: (text, host). Whether too few words stand outside lines that many texts of the host share."""
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})

    def key(line):
        folded = regex.sub(r"(?<![\p{L}\p{N}])[0-9]+(?![\p{L}\p{N}])", "0", line.translate(lower))
        return folded.strip(" \t\n\x0b\x0c\r")

    seen = Counter((h, k) for t, h in {(t or "", h or "") for t, h in rows} for k in {key(x) for x in t.split("\n")})
    out = []
    for t, h in rows:
        words = [(len(re.findall(r"[^\x20\x09-\x0D]+", x)), seen[h or "", key(x)] >= min_docs) for x in (t or "").split("\n")]
        total = sum(n for n, _ in words)
        out.append((total - sum(n for n, often in words if often)) * 100 < total * percent)
    return out


def test_quality_line_rule_on_the_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()
    rows += [(10_000 + i, f"Page {i} of 20\nitem{i} stays {i}\n" + f"own{i} " * 3, "hot") for i in range(15)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["kept"] or r["base_failed"] for r in quality.judge(df).collect()}
    depleted = depleted_by_hand([(t, h) for _, t, h in rows])
    failed = [b[0] < 50 or 100 * b[4] > 50 * b[0] for b in (base_by_hand(t) for _, t, _ in rows)]
    assert got == {i: base or not gone for (i, _, _), gone, base in zip(rows, depleted, failed)}
    words = {r["doc_id"]: r["n_frequent_words"] for r in quality.judge(df).collect()}
    assert all(words[10_000 + i] == 4 for i in range(15))


def test_quality_base_odd_rows(spark, odd, none):
    got = Counter(tuple(r[c] for c in (*quality.BASE, "base_failed")) for r in quality.judge(odd).collect())
    want = Counter((*b, b[0] < 50 or 100 * b[4] > 50 * b[0]) for b in (base_by_hand(r["text"]) for r in odd.collect()))
    assert got == want
    assert quality.judge(none).count() == 0 and quality.kept_rows(none).columns == none.columns


def test_quality_rejects_depleted_and_keeps_copies(spark):
    own = lambda i, n: " ".join(f"w{i}x{j}" for j in range(n))
    menu = [" ".join(f"menu{k} item{j}" for j in range(8)) for k in range(5)]
    poor = [(i, "\n".join([*menu, own(i, 4)]), "a") for i in range(12)]
    rich = [(100 + i, "\n".join([*menu[:1], own(i, 80)]), "a") for i in range(12)]
    copies = [(200 + i, own(9, 90), "a") for i in range(40)]
    elsewhere = [(300, "\n".join([*menu, own(3, 4)]), "b")]
    df = spark.createDataFrame(poor + rich + copies + elsewhere, "doc_id long, text string, source string")
    kept = {r["doc_id"] for r in quality.kept_rows(df).collect()}
    assert kept == {r[0] for r in rich + copies + elsewhere}


def test_quality_counts_long_lines(spark):
    notice = " ".join(f"legal{j}" for j in range(60))
    assert len(notice) > 200
    rows = [(i, f"{notice} {2000 + i}\nown{'i' * i} tail", "a") for i in range(10)] + [(100, f"{notice} 2000\nown tail", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r["doc_id"]: r["n_frequent_words"] for r in quality.judge(df).collect()} == {**dict.fromkeys(range(10), 61), 100: 0}
    assert [r["doc_id"] for r in quality.kept_rows(df).collect()] == [100]


def test_quality_rejects_a_small_cluster_of_a_hot_host(spark):
    menu = " ".join(f"menu item {chr(97 + j)}" for j in range(20))
    poor = [(i, f"{menu}\n{'x' * (i + 1)} tail", "hot") for i in range(12)]
    other = [(100 + i, " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{'y' * j}" for j in range(60)), "hot") for i in range(400)]
    df = spark.createDataFrame(poor + other, "doc_id long, text string, source string")
    assert {r["doc_id"] for r in quality.judge(df).filter("n_frequent_words > 0").collect()} == {r[0] for r in poor}
    assert quality.kept_rows(df).count() == len(other)


ITEMS = [("a", "one two three four five six seven eight nine ten eleven"), ("b", "Solo"), ("c", None), (None, "!!"), ("d", "short item here"), ("d", "short item here")]


def hits_by_hand(text, items, n=10):
    words = decontaminate.words_of(text)
    hit, found = set(), set()
    for item, own in items:
        w = decontaminate.words_of(own)
        size = min(n, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            for at in range(len(words) - size + 1):
                if words[at : at + size] == w[i : i + size]:
                    hit.update(range(at, at + size))
                    found.add(item or "")
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_decontamination_odd_rows(spark, odd, none, block_bytes):
    texts = [r["text"] for r in odd.collect()]
    texts += ["x " + ITEMS[0][1].upper() + ". solo", "one two three four five six seven eight nine", "SHORT, item\nhere-solo short item here"]
    df = odd.unionByName(spark.createDataFrame([(t,) for t in texts[len(TEXTS) + 13 :]], "text string"), allowMissingColumns=True)
    bench = spark.createDataFrame(ITEMS, "item_id string, text string")
    found = decontaminate.find(df, bench, block_bytes=block_bytes)
    got = Counter((r["found"]["n_words"], sum(s["end"] - s["start"] for s in r["found"]["spans"]), tuple(r["found"]["items"])) for r in found.collect())
    assert got == Counter((n, h, tuple(i)) for n, h, i in (hits_by_hand(t, ITEMS) for t in texts))
    assert decontaminate.find(none, bench).count() == 0 and decontaminate.find(df, bench.limit(0)).count() == len(texts)


def test_spans_are_cut(spark):
    df = spark.createDataFrame([(1, "Keep this: " + ITEMS[0][1] + "! And é that."), (2, "clean\ttext"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS[:1], "item_id string, text string")
    got = dict(decontaminate.without_spans(df, bench).select("doc_id", "text").collect())
    assert got == {1: "Keep this: ! And é that.", 2: "clean\ttext", 3: None}
    assert [r[0] for r in decontaminate.without_contaminated(df, bench).select("doc_id").orderBy("doc_id").collect()] == [2, 3]


@pytest.fixture(scope="module")
def reference_encoding():
    with open(RANKS, "rb") as lines:
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(lines), special_tokens={})


def test_bpe_odd_rows(spark, odd, none, reference_encoding):
    extra = ["<unk> <s> \x00", "日本語 👍🏽 ▁x", "ſtrange's WE'LL  \n\n "]
    df = odd.unionByName(spark.createDataFrame([(t,) for t in extra], "text string"), allowMissingColumns=True)
    texts = [r["text"] or "" for r in df.collect()]
    got = Counter(tuple(r[c] for c in byte_bpe.MADE) for r in byte_bpe.digests(df, RANKS, public_tokenizers.PATTERN).collect())
    ids = [reference_encoding.encode_ordinary(t) for t in texts]
    assert got == Counter((len(i), sha(" ".join(map(str, i))), sha(t)) for i, t in zip(ids, texts))
    coded = byte_bpe.encode(df, RANKS, public_tokenizers.PATTERN)
    assert Counter(tuple(r["ids"]) for r in coded.collect()) == Counter(map(tuple, ids))
    assert byte_bpe.digests(none, RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_query(spark, reference_encoding):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op8_byte_bpe"](spark, SF).collect():
        ids = reference_encoding.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(texts[r["doc_id"]]))


def test_bpe_rejects_gaps():
    with pytest.raises(ValueError, match="without gaps"):
        byte_bpe.serialise({bytes([b]): b + 1 for b in range(256)})


def groups_by_hand(rows, percent=85):
    def shingles(text):
        w = (text or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()

    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[find(i)] = find(j)
    best = {}
    for i, (doc, _) in enumerate(rows):
        best[find(i)] = min(best.get(find(i), (True, 0)), (doc is None, doc or 0))
    return Counter((doc, len(sets[i]), None if best[find(i)][0] else best[find(i)][1]) for i, (doc, _) in enumerate(rows) if sets[i]) + Counter(
        (doc, 0, doc) for i, (doc, _) in enumerate(rows) if not sets[i]
    )


def near_rows():
    """A chain whose ends are not similar, a dense group, pairs just above and below the threshold, short texts."""
    base = [f"t{i}" for i in range(200)]
    swap = lambda words, at, mark: [f"{mark}{i}" if i in at else w for i, w in enumerate(words)]
    rows = [(i, " ".join(swap(base, range(3 * i), "c"))) for i in range(12)]
    rows += [(100 + i, " ".join(swap([f"d{k}" for k in range(120)], {i % 110}, f"m{i}"))) for i in range(90)]
    rows += [(300, " ".join(f"e{k}" for k in range(104))), (301, " ".join(f"e{k}" for k in range(85 + 4))), (302, " ".join(f"e{k}" for k in range(88)))]
    return rows + [(400, "one two"), (401, "ONE  two"), (402, "one two three"), (403, None), (404, " "), (None, "one two"), (400, "one two")]


@pytest.mark.parametrize("leaf", [64, 4])
def test_near_duplicates(spark, leaf):
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = near_dup.groups(df, leaf=leaf).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == groups_by_hand(rows)
    per_group = Counter(r["component_id"] for r in got if r["kept"] and r["n_shingles"])
    assert set(per_group.values()) == {1}


def test_intersections_of_a_cell():
    pick = np.random.default_rng(0)
    base = pick.integers(0, 2**62, 300).astype(np.uint64)
    for one in (True, False):
        sets = [np.unique(np.concatenate([pick.choice(base, pick.integers(1, 300), replace=False), pick.integers(0, 60, 9).astype(np.uint64)])) for _ in range(120)]
        left = np.arange(0, 120, 1 if one else 2)
        right = left if one else np.arange(1, 120, 2)
        counts = near_dup.intersections(sets, left, right)
        want = [[len(np.intersect1d(sets[a], sets[b])) if a != b else counts[i, j] for j, b in enumerate(right)] for i, a in enumerate(left)]
        assert (counts == np.array(want)).all()


def exact_groups(texts, percent):
    """Groups of all texts by an exact join: two sets that link share one of the first shingles in an order by rarity."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if (w := (t or "").encode().lower().split()) else set() for t in texts]
    often = Counter(s for own in sets for s in own)
    parent, seen = list(range(len(texts))), defaultdict(list)

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i in sorted(range(len(texts)), key=lambda i: len(sets[i])):
        own = sorted(sets[i], key=lambda s: (often[s], s))
        first = own[: len(own) - -(-percent * len(own) // 100) + 1] if own else []
        for j in {j for s in first for j in seen[s]}:
            if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
        for s in first:
            seen[s].append(i)
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates_miss_no_link_of_the_table(spark, percent):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    rows = sorted(map(tuple, docs.collect()))
    label, smallest = exact_groups([t for _, t in rows], percent), {}
    for (i, _), g in zip(rows, label):
        smallest.setdefault(g, i)
    got = {r["doc_id"]: r["component_id"] for r in near_dup.groups(docs, percent=percent).collect()}
    assert got == {i: smallest[g] for (i, _), g in zip(rows, label)}


def test_near_duplicates_below_the_threshold_are_no_pair_rows(spark):
    """300 texts of one passage, all pairs a little below the threshold: they meet in one dense node and do not link."""
    passage = [f"t{k}" for k in range(200)]
    texts = [" ".join(w if (k + 3 * i) % 28 else f"m{i}x{k}" for k, w in enumerate(passage)) for i in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = groups_by_hand(list(enumerate(texts)))
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dup.groups(df, leaf=8).collect()) == want


def test_near_duplicates_at_eighty_percent(spark):
    """Pairs of similarity 0.82, which the pipeline's stage has to link."""
    rows = [(2 * k + b, " ".join(f"p{k}q{i}" for i in range(86 if b else 104)), "en", "s", 0) for k in range(60) for b in (0, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert near_dup.groups(df).filter("kept").count() == 120
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, df, SF).collect()) == [2 * k for k in range(60)]
    assert (near_dup.trees_for(85), near_dup.trees_for(80), near_dup.margin(85), near_dup.margin(80)) == (4, 5, 0.22, 0.25)


def test_near_duplicates_odd_rows(spark, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dup.groups(odd).collect()) == groups_by_hand(rows)
    left = near_dup.without_near_duplicates(odd)
    assert left.columns == odd.columns and left.filter(F.col("text") == LONG).count() == 1
    assert near_dup.groups(none).count() == 0


def test_forest_joins_what_the_links_join():
    pick = np.random.default_rng(5)
    for _ in range(50):
        a, b = pick.integers(0, 60, 300), pick.integers(0, 60, 300)
        a, b = a[a != b], b[a != b]
        kept = near_dup.forest(a, b)
        whole, small = near_dup.spanning(a, b, 60), near_dup.spanning(a[kept], b[kept], 60)
        assert (whole == small).all() and len(kept) < 2 * 60
    assert len(near_dup.forest(np.zeros(0, int), np.zeros(0, int))) == 0
