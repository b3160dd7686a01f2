import random
import re
from collections import Counter

from checks import compare
from statetrail.llm import quality_ledger as q


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    many = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if many[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), len(covered))


def test_measurements_as_plain(docs_of):
    rnd = random.Random(1)
    texts = ["".join(rnd.choices("ab #$\n\té", k=rnd.randint(0, 80))) for _ in range(200)]
    texts += ["x y z " * 40, "a a a a", "a b c a b c d", "😀 " * 60, "one\n\none\n \none"]
    for r in q.ledger(docs_of(texts)).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain(
            texts[r.doc_id])


def test_bits_verdicts_and_ablations(docs_of):
    good = " ".join(f"word{i}" for i in range(60))
    texts = [good, "too few", good + " $$$$$$$$$$$$", "x y z " * 40, "", "$ " * 20]
    rows = q.ledger(docs_of(texts)).withColumn("kept", q.verdict())
    kept = {r.doc_id: (r.kept, r.failures) for r in rows.collect()}
    assert kept[0] == (True, 0) and kept[1] == (False, 1) and kept[2] == (False, 4)
    assert not kept[3][0] and kept[3][1] & 2 and kept[4] == (False, 1)
    found = {r.rule: (r.n_failed, r.n_only) for r in q.ablations(rows).collect()}
    assert set(found) == set(q.POLICIES[q.CURRENT])
    for rule in q.RULES:
        if rule.name in found:
            bits = [f & q.mask(q.CURRENT) for _, f in kept.values()]
            assert found[rule.name] == (sum(bool(b & 1 << rule.bit) for b in bits),
                                        sum(b == 1 << rule.bit for b in bits))


def test_masks_of_old_policies_stay():
    assert (q.mask("base"), q.mask("2024-1"), q.mask("2024-1-strict")) == (3, 127, 255)


def test_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    df = q.op5_quality_rules(spark, folder)
    cursor = compare.connect(folder).execute(q.OP5_SQL)
    names = [d[0] for d in cursor.description]
    assert compare.sorted_rows(df.columns, df.collect()) == compare.sorted_rows(names, cursor.fetchall())


def test_no_python_in_the_plan(spark):
    plan = q.op5_quality_rules(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_odd_rows(odd_docs, no_docs):
    found = [(r.doc_id, r.n_words, r.failures & 1) for r in q.ledger(odd_docs).collect()]
    assert len(found) == 9 and (1, 0, 1) in found and (2, 0, 1) in found and (3, 30_000, 0) in found
    assert found.count((4, 6, 1)) == 2 and (5, 0, 1) in found and (None, 6, 1) in found
    assert q.ledger(no_docs).collect() == []
