import hashlib
import random
import re

from checks import compare
from statetrail.llm import decontamination as d

ITEMS = "item_id long, text string"


def words(text):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def plain(texts, items, window=13):
    out = {}
    for doc_id, text in texts.items():
        own, hit, found = words(text), set(), set()
        for item_id, item in items:
            w = words(item)
            n = min(window, len(w))
            for s in range(len(w) - n + 1) if n else ():
                for at in range(len(own) - n + 1):
                    if own[at:at + n] == w[s:s + n]:
                        hit.update(range(at, at + n))
                        found.add(item_id)
        out[doc_id] = (len(own), len(hit), sorted(str(i) for i in found if i is not None),
                       len(hit) > 0 and 20 * len(hit) >= len(own))
    return out


def table(found):
    return {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in found.collect()}


def test_as_plain(spark, docs_of):
    rnd = random.Random(5)
    vocabulary = ["the", "of", "And", "x1", "É", "ü-b", "c.d", "Zz"]
    items = [(i, " ".join(rnd.choices(vocabulary, k=rnd.choice([0, 1, 2, 4, 7, 13, 20])))) for i in range(14)]
    items += [(3, items[3][1]), (77, items[5][1]), (None, "null id here of"), (78, None)]
    texts = {}
    for i in range(60):
        parts = [" ".join(rnd.choices(vocabulary, k=rnd.randint(0, 30)))]
        parts += [rnd.choice(items)[1] or "" for _ in range(rnd.randint(0, 2))]
        texts[i] = "; ".join(parts)
    found = d.decontamination(docs_of(texts), spark.createDataFrame(items, ITEMS))
    assert table(found) == plain(texts, items)


def test_shingles_beyond_the_broadcast_limit_go_in_blocks(spark, docs_of, monkeypatch):
    monkeypatch.setattr(d.common, "BROADCAST_CELLS", 60)
    rnd = random.Random(8)
    items = [(i, " ".join(rnd.choices("abcdefgh", k=rnd.choice([3, 14, 25])))) for i in range(8)]
    texts = {i: " ".join(["x y", items[i % 8][1], "z", items[(i * 3) % 8][1]]) for i in range(20)}
    texts |= {50: items[1][1][2:], 51: ""}
    found = d.decontamination(docs_of(texts), spark.createDataFrame(items, ITEMS))
    assert table(found) == plain(texts, items)


def test_many_rows_of_one_id(spark):
    item = " ".join(f"w{i}" for i in range(13))
    rows = [(1, item)] * 400 + [(None, f"{item} {i % 3}") for i in range(400)] + [(1, "other text")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    found = d.decontamination(docs, spark.createDataFrame([(9, item)], ITEMS)).collect()
    assert len(found) == 805 and sum(r.n_hit == 13 for r in found) == 800
    assert sorted({r.n_words for r in found}) == [2, 13, 14]


def test_a_part_of_a_window_is_no_hit(spark, docs_of):
    item = " ".join(f"w{i}" for i in range(13))
    texts = {1: item, 2: item.rsplit(" ", 1)[0], 3: item.replace("w6", "x"), 4: item + " " + "z " * 260,
             5: item + " z" * 247}
    found = table(d.decontamination(docs_of(texts), spark.createDataFrame([(9, item)], ITEMS)))
    assert {k: (v[1], v[3]) for k, v in found.items()} == {
        1: (13, True), 2: (0, False), 3: (0, False), 4: (13, False), 5: (13, True)}


def test_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    df = d.op6_decontamination(spark, folder)
    cursor = compare.connect(folder).execute(d.OP6_SQL)
    names = [c[0] for c in cursor.description]
    rows = df.collect()
    assert compare.sorted_rows(df.columns, rows) == compare.sorted_rows(names, cursor.fetchall())
    assert {r.items_sha256 for r in rows if not r.n_items} == {hashlib.sha256(b"").hexdigest()}


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "some words without an id here"), (2, "a b c d e f"), (3, "")], ITEMS)
    found = [(r.doc_id, r.n_words, r.n_hit, r.n_items) for r in d.decontamination(odd_docs, items).collect()]
    assert len(found) == 9 and (None, 6, 6, 1) in found and found.count((4, 6, 6, 1)) == 2
    assert d.decontamination(no_docs, items).collect() == []
    none = d.decontamination(odd_docs, items.filter("item_id > 5")).collect()
    assert len(none) == 9 and not any(r.contaminated for r in none)


def test_stage_drops_what_is_contaminated(spark, odd_docs, tmp_path):
    spark.createDataFrame([(2, "a b c d e f")], ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = d.drop_contaminated(spark, odd_docs, str(tmp_path))
    assert kept.columns == odd_docs.columns and sorted(
        r.doc_id for r in kept.collect() if r.doc_id) == [1, 2, 3, 5, 6, 7]
