"""Exact dedup, URL filters, mixing, license scans and the Jaccard join, against brute force and odd rows."""

import collections
import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from querylens.llm import exact_dedup, license_scan, mixing, ngram_join, queries, url_filter
from querylens.llm.common import stored
from querylens.llm.components import components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, lang string, n_chars long, n_shingles long, kept boolean, size long, host string, copies long"


def frame(spark, rows):
    """Documents of id and text (and source), with columns whose names an operator's own could clash with."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "s", "en", 1, 2, False, 3, "h", 4) for r in rows], DOCS)


LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "one two three"), (5, "One TWO three"), (6, "one two three"), (6, "one two three"), (7, LONG), (8, LONG + " end"), (None, "one two three four"), (9, "É é É é É"), (10, "é É é É é")]


def words(text):
    return re.findall(r"[^ \t-\r]+", text or "")


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = words(lower(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    index = collections.defaultdict(list)
    for i, s in sets.items():
        for j, n in collections.Counter(j for x in s for j in index[x]).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for x in s:
            index[x].append(i)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_texts(n=60):
    """Families of texts with edits, and a passage that all of them share."""
    passage = " ".join(f"shared{i}" for i in range(40))
    rows = []
    for f in range(6):
        base = [f"f{f}w{i}" for i in range(80)]
        for k in range(n // 6):
            w = list(base)
            for e in range(k):
                w[(e * 17 + f) % 80] = f"edit{f}_{k}_{e}"
            rows.append((f * 100 + k, " ".join(w) + (" " + passage if k % 2 else "")))
    return rows


@pytest.mark.parametrize("block", [1000, 3])
def test_jaccard_components(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = near_texts()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(frame(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_jaccard_query_on_whole_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries.op1_ngram_jaccard_join(spark, SF).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(docs)


def test_jaccard_odd_rows(spark):
    got = ngram_join.jaccard_components(frame(spark, ODD)).collect()
    assert len(got) == len(ODD)
    by = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got}
    assert by[1] == (0, 1) and by[2] == (0, 2) and by[3] == (0, 3)
    assert by[4] == by[5] == by[6] == (1, 4) and by[8][1] == 7 and by[9] != by[10]
    assert ngram_join.jaccard_components(frame(spark, ODD[:0])).count() == 0
    docs = stored(frame(spark, [r for r in ODD if r[0]]), "docs")
    kept = ngram_join.drop_near_copies(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, 3, 4, 7, 9, 10}


def brute_links(rows):
    """Numbers of linked rows, by place."""
    sets = []
    for _, t in rows:
        w = words(lower(t))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    return {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j and a and b and 100 * len(a & b) >= 75 * len(a | b)}


@pytest.mark.parametrize("block", [1000, 3])
def test_jaccard_links_within_components(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = near_texts() + [(900, near_texts()[0][1]), (901, None), (None, near_texts()[0][1]), (902, ""), (903, "a b"), (904, "A b")]
    want = brute_links(rows)
    by_text = collections.Counter(i for i, _ in want)
    got = ngram_join.link_counts(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["n_links"] for r in got} == {i: by_text[k] for k, (i, _) in enumerate(rows)}
    links, members = ngram_join.jaccard_links(frame(spark, rows))
    name = {r["doc_id"]: r["d1"] for r in members.collect()}
    pairs = [(r["a"], r["b"]) for r in links.collect()]
    assert len(pairs) == len(set(pairs))
    ids = [i for i, _ in rows]
    assert set(pairs) == {(name[ids[i]], name[ids[j]]) for i, j in want if name[ids[i]] < name[ids[j]]}
    assert ngram_join.link_counts(frame(spark, [])).count() == 0


def test_jaccard_links_query_on_whole_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    count = collections.Counter(i for i, _ in brute_links(docs))
    assert {r["doc_id"]: r["n_links"] for r in queries.op1_ngram_jaccard_links(spark, SF).collect()} == {d: count[k] for k, (d, _) in enumerate(docs)}


def test_prefix_and_signature_bounds():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(50):
        n, m = rng.integers(1, 300, 2)
        pool = np.unique(rng.integers(0, 1 << 63, 400).astype(np.uint64))
        a, b = (np.sort(rng.choice(pool, min(k, len(pool)), replace=False)) for k in (n, m))
        s, t = ngram_join.signature(a), ngram_join.signature(b)
        size = min(len(s), len(t))
        assert s.sum() == len(a) and np.minimum(ngram_join.folded(s, size), ngram_join.folded(t, size)).sum() >= len(np.intersect1d(a, b))


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 120)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 120)}


def check_dedup(rows, got):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    assert len(got) == len(rows)
    for r, n in collections.Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got).items():
        text = next(t or "" for i, t in rows if i == r[0] and hashlib.sha256((t or "").encode()).hexdigest() == r[3])
        assert r[1] == max(x for x in groups[text] if x is not None) and r[2] == len(groups[text]) and n >= 1


def test_exact_dedup(spark, tmp_path):
    rows = [r for r in ODD if r[0]]
    docs = stored(frame(spark, rows), "docs")
    got = exact_dedup.dedup(docs).collect()
    check_dedup(rows, got)
    # Of the repeated row 6 one row stays.
    assert sorted(r["doc_id"] for r in got if r["kept"]) == [2, 3, 5, 6, 7, 8, 9, 10]
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 5, 6, 7, 8, 9, 10]
    other = exact_dedup.dedup(frame(spark, rows)).collect()  # not read from files
    check_dedup(rows, other)
    assert sorted(r["doc_id"] for r in other if r["kept"]) == [2, 3, 5, 6, 7, 8, 9, 10]
    assert exact_dedup.dedup(stored(frame(spark, rows[:0]), "docs")).count() == 0


CLASHES = ("g_text", "g_at", "digest", "locator", "content", "row", "m_hash", "m_size", "p_due", "p", "name", "size", "rank", "copies", "fm_score", "d1", "root", "source_size", "template")


def clashing(spark, rows):
    """Documents of id, text and source with columns of the names in CLASHES."""
    docs = spark.createDataFrame([(*r, "s")[:3] for r in rows], "doc_id long, text string, source string")
    return docs.select("*", *(F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in CLASHES))


def test_clashing_columns_come_back_as_they_were(spark):
    rows = [(1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (3, "q", "x"), (4, None, "x"), (5, "a b c d e f g h i j k l m n o p q r s t u v w x y z", "x")]
    for docs in (clashing(spark, rows), stored(clashing(spark, rows), "docs")):
        for got, ids in ((exact_dedup.drop_copies(docs), {2, 3, 4, 5}), (ngram_join.drop_near_copies(docs), {1, 3, 4, 5}), (mixing.mix(docs), None)):
            assert got.columns == docs.columns
            found = got.collect()
            assert found and (ids is None or {r["doc_id"] for r in found} == ids)
            assert all(r[c] == f"{c}{r['doc_id']}" for r in found for c in CLASHES)
        assert license_scan.license_labels(docs).count() == len(rows)


def test_dedup_goes_on_from_its_state(spark, tmp_path):
    path, checkpoint = str(tmp_path / "docs"), str(tmp_path / "state")
    frame(spark, [(1, "a"), (2, "b")]).coalesce(1).write.parquet(path)
    schema = spark.read.parquet(path).schema
    assert exact_dedup.dedup_files(spark, path, schema, checkpoint).where("kept").count() == 2
    frame(spark, [(3, "a"), (4, "c")]).coalesce(1).write.mode("append").parquet(path)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.dedup_files(spark, path, schema, checkpoint).collect()}
    assert got == {1: (3, 2), 3: (3, 2), 2: (2, 1), 4: (4, 1)}


def test_clashing_digests_are_told_apart_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.lit("same"))
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.dedup(frame(spark, [(1, "a"), (2, "b"), (3, "a")])).collect()}
    assert got == {1: (3, 2), 3: (3, 2), 2: (2, 1)}
    # Repeated ids keep a row each; of the repeated row one stays.
    got = [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.dedup(frame(spark, [(1, "a"), (1, "b"), (3, "a"), (3, "a"), (None, "b")])).collect()]
    assert sorted(got, key=str) == sorted([(1, 3, 3, False), (1, 1, 2, True), (3, 3, 3, True), (3, 3, 3, False), (None, 1, 2, False)], key=str)


URLS = [None, "", "no scheme", "http://NET", "http://net/", "http://a.Net/x?y", "https://www.example.net/en/1", "https://example.com/de/", "http://x.example.com/dextra", "http://org/fr/a#b", "http://notnet/", "http://example.net/EN/", "http://a://b.net/c", "x://a.net?/q"]


def test_url_trie_join_and_brute_force(spark):
    def brute(host, path):
        fit = [r for r in url_filter.PAGE_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fit, key=lambda r: r.order, default=None)
        return (best.text, best.verdict) if best else (None, "allow")

    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate(URLS * 2)], "page_id long, url string, rule string")
    for found in (url_filter.filter_urls(pages), url_filter.filter_urls(pages, max_trie_bytes=0)):
        got = found.collect()
        assert len(got) == len(URLS) * 2
        for r in got:
            u = URLS[r["page_id"] % len(URLS)] or ""
            rest = u.split("://", 1)[1] if "://" in u else ""
            host = lower(re.split("[/?#]", rest)[0])
            path = re.split("[?#]", rest[len(host) :])[0] if rest else ""
            assert (r["host"], r["path"]) == (host, path) and (r["rule"], r["verdict"]) == brute(host, path), u
    assert url_filter.filter_urls(pages.limit(0)).count() == 0
    tails = [url_filter.Rule("block", "a.b", "/x/ye"), url_filter.Rule("allow", "b", "/x/"), url_filter.Rule("block", "b", "")]
    one = spark.createDataFrame([(1, "h://a.b/x/yes"), (2, "h://a.b/x/no"), (3, "h://c.b")], "page_id long, url string")
    for limit in (1 << 20, 0):
        assert {r["page_id"]: r["rule"] for r in url_filter.filter_urls(one, tails, max_trie_bytes=limit).collect()} == {1: "a.b/x/ye", 2: "b/x/", 3: "b"}


def brute_targets(size):
    names = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), sum(size.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * size[s]}
        if not over:
            return target | share
        target |= {s: 3.0 * size[s] for s in over}
        left -= sum(3 * size[s] for s in over)
        open_ -= over


def test_mixing(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 40)), ["b", "a", "c", "d", None][i * i % 5]) for i in range(400)] + [(900, None, "z"), (901, "", None), (5, "w w", "b"), (5, "w w", "b")]
    docs = frame(spark, rows)
    columns = (F.col("row.source"), F.col("size"), F.col("p.source_size"), F.col("p.target"), F.col("copies"), F.col("row.doc_id"))
    got = mixing.with_copies(docs, mixing.mix_plan(docs)).select(*columns).collect()
    assert len(got) == len(rows)
    size = collections.Counter()
    for _, t, s in rows:
        size[s] += len(words(t))
    want, taken = brute_targets(size), collections.Counter()
    for r in got:
        assert r["source_size"] == size[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 and 0 <= r["copies"] <= 3
        taken[r["source"]] += r["copies"] * r["size"]
    assert all(abs(taken[s] - want[s]) <= 40 for s in size)
    again = mixing.with_copies(docs.repartition(7), mixing.mix_plan(docs.repartition(3))).select(*columns).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in got)
    weighed = docs.withColumn("worth", F.col("doc_id") % 5 + 1)
    plan = mixing.mix_plan(weighed, importance="worth")
    assert mixing.with_copies(weighed, plan, importance="worth").agg(F.max("copies")).first()[0] <= 3
    assert mixing.mix(frame(spark, [])).count() == 0


def test_mixing_includes_as_often_as_stated(spark):
    """Over many seeds documents are drawn as often as their unequal probabilities say, and words come near the target."""
    rows = [(i, " ".join(["w"] * (2 + i * i % 61)), "ab"[i % 3 == 0]) for i in range(600)]
    docs = stored(frame(spark, rows), "docs")
    taken, chance, seeds = collections.Counter(), {}, 5
    for seed in range(seeds):
        for r in mixing.with_copies(docs, mixing.mix_plan(docs, seed=seed), seed=seed).select("row.doc_id", "chance", "copies", "p.certain", "p.due").collect():
            if r["due"] > 0:
                taken[r["doc_id"]] += r["copies"] - r["certain"]
                chance[r["doc_id"]] = r["chance"]
    assert len(set(chance.values())) > 10
    assert all(taken[i] == seeds for i, p in chance.items() if p >= 1)
    open_ = {i: p for i, p in chance.items() if p < 1}
    for low, high in ((0, 0.25), (0.25, 0.5), (0.5, 0.75), (0.75, 1)):
        some = [i for i, p in open_.items() if low <= p < high]
        assert len(some) < 20 or abs(sum(taken[i] for i in some) / seeds / len(some) - sum(open_[i] for i in some) / len(some)) < 0.08


def test_mixing_without_ids(spark):
    """A third of all rows without an id, most of them the same text: still near the target, and the same in a second run."""
    rows = [(None, "one two three", "a")] * 300 + [(i, "w " * (1 + i % 9), "ab"[i % 2]) for i in range(600)]
    docs = stored(frame(spark, rows).repartition(3), "docs")
    got = [sorted(map(repr, mixing.mix(docs).select("doc_id", "text", "source").collect())) for _ in range(2)]
    plan = {r["source"]: r["target"] for r in mixing.mix_plan(docs).collect()}
    words_taken = collections.Counter()
    for r in mixing.mix(docs).collect():
        words_taken[r["source"]] += len(words(r["text"]))
    assert got[0] == got[1] and all(abs(words_taken[s] - t) <= 9 for s, t in plan.items())


def brute_license(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    places = [(i, label) for phrase, label in license_scan.PHRASES for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    return len(w), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted({x for _, x in places}))


def test_license_scan(spark, monkeypatch):
    mit = license_scan.TEMPLATES[1][1]
    changed = mit.replace("free of charge", "entirely free of any charge")
    rows = [*ODD, (20, "Released under the MIT License.\nMIT license"), (21, "x " * 50 + changed.title() + " y" * 30), (22, "Licensed under CC BY-NC 4.0."), (23, "general public; license MITlicense"), (24, "permission is hereby granted to nobody"), (25, "Apache License general public license"), (26, "MİT license É-ß")]
    got = license_scan.license_labels(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t for i, t in rows if i == r["doc_id"])
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_license(text)
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    labels = {r["doc_id"]: (r["labels"], r["score"]) for r in got}
    assert labels[21][0] == "mit" and labels[21][1] >= 0.6 and labels[22] == ("cc-by-nc", 1.0) and labels[24][0] == "" and labels[23][0] == "gpl" and labels[25][0] == "apache,gpl"
    found = license_scan.spans(license_scan.hits(frame(spark, rows)))
    span = found.where("doc_id = 21 and label = 'mit'").orderBy(F.desc("score")).first()
    assert (span["first_word"], span["last_word"]) == (50, 50 + len(changed.split()) - 1)
    assert license_scan.license_labels(frame(spark, [])).count() == 0
    # Whole license texts and short names as a table of templates, broadcast or not, give the same.
    mine = [("long", " ".join(f"term{i} clause{i % 7}" for i in range(400))), ("short", "unlicense v1"), *license_scan.TEMPLATES]
    docs = frame(spark, [(1, mine[0][1]), (2, "the Unlicense v1."), (3, " ".join(mine[0][1].split()[:300])), (None, "x"), (None, "x")])
    results = []
    for limit in (100_000, 10):
        monkeypatch.setattr(license_scan, "BROADCAST_GRAMS", limit)
        results.append(sorted((r["doc_id"] or 0, r["labels"], r["score"]) for r in license_scan.license_labels(docs, templates=mine).collect()))
    assert results[0] == results[1] and [r[1] for r in results[0]] == ["", "", "long", "short", ""]


def test_license_query_on_whole_table(spark):
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op9_license_scan(spark, SF).collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_license(text[r["doc_id"]])


def test_folds_are_checksums(spark):
    from querylens.llm.labelled import fold

    got = spark.range(50).select(F.col("id").alias("doc_id"), fold().alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["doc_id"]).encode()) % 3 for r in got)


def test_voronoi_cells_lose_no_link_and_meet_once():
    import numpy as np

    rng = np.random.default_rng(3)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 1 << 62, rng.integers(20, 200))
        for _ in range(8):
            s = base.copy()
            k = rng.integers(0, len(s) // 2)
            s[rng.choice(len(s), k, replace=False)] = rng.integers(0, 1 << 62, k)
            sets.append(np.unique(s.astype(np.uint64)))
    drawn = [sets[i] for i in rng.choice(len(sets), 12, replace=False)]
    pivots = ngram_join.Pivots(drawn)
    d = np.array([pivots.distances(s) for s in sets])
    jaccard = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert np.allclose(d, [[1 - jaccard(s, p) for p in drawn] for s in sets])
    where = [ngram_join.cells_of(row) for row in d]
    assert len({home for home, _ in where}) > 5 and pivots.tell_apart(drawn) and not pivots.tell_apart([sets[0]] * 8)
    met = 0
    for i, (home, visits) in enumerate(where):
        for j in range(i):
            # Together where both are, unless both are guests.
            cells = [(c, c != home, c != where[j][0]) for c in {home, *visits} & {where[j][0], *where[j][1]}]
            times = sum(not (g and h) for _, g, h in cells)
            assert times <= 1
            if 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j])):
                assert times == 1
                met += 1
    assert met > 30
