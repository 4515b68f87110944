"""Near-duplicates and benchmark windows against brute force."""

from __future__ import annotations

import random
import re

from airlake.llm import decontaminate, minhash_tensor
from tests.llm import cases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(t):
    w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()


def components(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    best = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(best[a], best[b])
            if best[a] != m or best[b] != m:
                best[a] = best[b] = m
                changed = True
    return sets, best


def agrees(got, rows):
    sets, best = components(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), best[r["doc_id"]], best[r["doc_id"]] == r["doc_id"])
    assert len(got) == len(rows)


def test_components_equal_brute_force(docs):
    agrees(minhash_tensor.near_duplicates(docs).collect(), cases.ROWS)


def test_chains_and_groups_that_leaders_leave_open(spark):
    """Texts that share much but too little with the leader, chains of links, and a hot group of copies."""
    r = random.Random(5)
    shared = [f"s{k}" for k in range(120)]
    rows = []
    for k in range(30):
        own = [f"o{k // 2}_{j}" for j in range(60)]
        if k % 2:
            own[30] = "x"
        rows.append((k, " ".join(shared + own)))
    chain = [f"c{k}" for k in range(200)]
    for k in range(20):
        rows.append((100 + k, " ".join(chain[k * 5 : k * 5 + 100])))
    rows += [(1000 + k, " ".join(chain[:80])) for k in range(300)]
    base = [f"n{k}" for k in range(150)]
    for k in range(150):
        edited = list(base)
        edited[r.randrange(150)] = f"e{k}"
        rows.append((2000 + k, " ".join(edited)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    agrees(minhash_tensor.near_duplicates(df).collect(), rows)


def test_near_duplicates_of_no_rows(bare, no_docs):
    assert minhash_tensor.near_duplicates(bare).count() == 0
    assert minhash_tensor.without_near_duplicates(no_docs).count() == 0


def test_one_of_each_group_stays(docs):
    left = minhash_tensor.without_near_duplicates(docs)
    assert left.columns == docs.columns
    _, best = components(cases.ROWS)
    want = sorted({b for b in best.values()})
    assert sorted(r["doc_id"] for r in left.collect() if r["doc_id"] is not None) == want
    assert left.filter("doc_id is null").count() == 1


def words(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))


def windows(items, n=10):
    out = {}
    for i, t in items:
        w = words(t)
        for k in range(max(len(w) - n, 0) + 1) if w else ():
            out.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    return out


def test_hits_equal_brute_force(docs, items):
    cut = windows([(i, t) for i, t, _ in cases.ITEMS])
    lengths = {len(k) for k in cut}
    want = {}
    for i, t in cases.ROWS:
        w, hit, found = words(t), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                owners = cut.get(tuple(w[k : k + n]))
                if owners:
                    hit |= set(range(k, k + n))
                    found |= owners
        want[i] = len(w), len(hit), sorted(found)
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.contamination(docs, items).collect()}
    assert got == want
    left = decontaminate.without_contaminated(docs, items)
    assert left.columns == docs.columns
    assert {r["doc_id"] for r in left.collect()} == {i for i, (_, n, _) in want.items() if not n}


def test_no_items_and_no_documents(docs, no_docs, items):
    assert decontaminate.contamination(docs, items.limit(0)).filter("n_hit > 0").count() == 0
    assert decontaminate.contamination(no_docs, items).count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red one two blue"), (2, "blue a b c d e red"), (3, "red red x blue"), (4, "blue")], "doc long, text string")
    groups = spark.createDataFrame([("g", ["red", "blue"])], "group string, terms array<string>")
    split = docs.select("doc", decontaminate.words(docs["text"]).alias("words"))
    assert sorted(r["doc"] for r in decontaminate.proximity_matches(split, groups, 4).collect()) == [1, 3]
    assert sorted(r["doc"] for r in decontaminate.proximity_matches(split, groups, 3).collect()) == [3]


def test_ids_that_repeat_or_lack_go_by_their_own_texts(spark):
    """Rows of one id with different texts, rows without ids, and copies: a row for each row, and no link or hit is lost."""
    a, b = cases.prose(31, 80), cases.prose(32, 80)
    item = cases.prose(33, 12)
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (None, f"x {item} y"), (None, "clean text without anything"), (4, f"{item} z"), (4, "clean"), (5, item), (5, item)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash_tensor.near_duplicates(df).collect()}
    n = {i: len(shingles(t)) for i, t in ((2, rows[2][1]), (3, rows[3][1]), (1, a))}
    assert {(2, n[2], 1, False), (3, n[3], 1, False), (1, n[1], 1, True)} <= got
    # Row 5 is a near copy of one text of id 4.
    left = sorted((r["doc_id"] or 0, r["text"]) for r in minhash_tensor.without_near_duplicates(df).collect())
    assert left == sorted([(1, a), (1, b), (0, rows[4][1]), (0, rows[5][1]), (4, rows[6][1]), (4, "clean")])
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    found = sorted((r["doc_id"] or 0, r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.contamination(df, items).collect())
    size = len(words(item))
    want = [(i or 0, len(words(t)), size if item in t else 0, ["7"] if item in t else []) for i, t in rows]
    assert found == sorted(want)
    clean = sorted((r["doc_id"] or 0, r["text"]) for r in decontaminate.without_contaminated(df, items).collect())
    assert clean == sorted((i or 0, t) for i, t in rows if item not in t)


def test_a_long_text_full_of_one_phrase(spark):
    """A phrase that stands in thousands of places of one text, and overlaps itself."""
    text, item = "same " * 3000 + "end", "same " * 12
    df = spark.createDataFrame([(1, text), (2, text), (3, "same " * 9)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"]) for r in decontaminate.contamination(df, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {1: (3001, 3000), 2: (3001, 3000), 3: (9, 0)}


def test_tables_of_links_are_short_and_those_no_longer_read_go(spark, tmp_path, monkeypatch):
    from pathlib import Path

    from airlake import session
    from airlake.llm import minhash_tensor as H

    monkeypatch.setattr(session, "work_dir", lambda spark: str(tmp_path))
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    words = [f"w{i}" for i in range(60)]
    texts = [[*words, *[f"x{k}y{i}" for i in range(k % 9)]] for k in range(40)]
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "24")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found = H.near_duplicates(spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")).collect()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert {r.component_id for r in found} == {0} and len(found) == 40
    names = [p.name for p in tmp_path.iterdir()]
    assert not [n for n in names if n.startswith(("buckets-", "live-buckets-"))]
    stars = [p for p in Path(tmp_path).iterdir() if p.name.startswith(("links-", "large-star-", "small-star-"))]
    assert stars and all(len([*p.glob("part-*")]) <= H.LEAST_TASKS for p in stars)


def test_texts_that_only_the_middle_of_a_large_group_links_are_no_pairs_of_the_exact_join(spark, monkeypatch):
    """Copies with two edits each, and texts with three edits that few of the copies but the text without edits link."""
    r = random.Random(8)
    base = [f"n{k}" for k in range(150)]

    def edited(k, n):
        words = list(base)
        for at in r.sample(range(5, 145, 6), n):
            words[at] = f"e{k}_{at}"
        return " ".join(words)

    rows = [(500, " ".join(base))] + [(k, edited(k, 2)) for k in range(250)] + [(1000 + k, edited(1000 + k, 3)) for k in range(50)]
    proposed, across = [0], minhash_tensor._across

    def counted(*tables):
        pairs = across(*tables)
        proposed.append(pairs.count())
        return pairs

    monkeypatch.setattr(minhash_tensor, "_across", counted)
    agrees(minhash_tensor.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect(), rows)
    assert max(proposed) <= 100
