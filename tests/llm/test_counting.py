import random

from frames import no_docs, odd_docs
from pyspark.sql import functions as F

from tallyforge.llm.counting import LEAF, Tokenizer, Tree, apply_edits, build_trees, drill_edits, read_vocabulary

SIGNS = ["a", "b", "'", "s", "l", "t", " ", " ", "\n", "\t", "1", "9", ".", "!", "é", "ß", "中", "re", "'ll", "don't ", " the", "  ", "_"]
TOKENIZER = Tokenizer(read_vocabulary())


def some(rng, n):
    return "".join(rng.choice(SIGNS) for _ in range(n))


def whole(text):
    return len(TOKENIZER.encoding.encode_ordinary(text))


def test_edited_trees_equal_rebuilt_ones():
    rng = random.Random(3)
    for _ in range(400):
        text = some(rng, rng.choice([0, 1, 3, 10, 60, 900]))
        tree = Tree.build(text, TOKENIZER)
        for _ in range(rng.randint(1, 8)):
            start, remove, insert = rng.randint(-1, len(text) + 2), rng.choice([0, 0, 1, 2, 5, 50]), some(rng, rng.choice([0, 1, 2, 5, 40, 600]))
            s = min(max(start, 0), len(text))
            want = text[:s] + insert + text[s + min(remove, len(text) - s) :]
            text, _ = tree.edit(text, start, remove, insert, TOKENIZER)
            tree = Tree.unpack(tree.pack())
            assert text == want
            assert [n for a, _ in tree.leaves for n in a] == [len(p) for p in TOKENIZER.split(text)]
            assert (tree.n_chars, tree.n_tokens) == (len(text), whole(text))


def test_an_edit_encodes_little_of_a_long_text():
    text = "The quick brown fox jumps. " * 4000
    tree = Tree.build(text, TOKENIZER)
    _, encoded = tree.edit(text, 50_000, 3, "cat", TOKENIZER)
    assert encoded < 10 and len(tree.leaves) > 20_000 / LEAF


def test_operator_on_odd_rows(spark):
    trees = build_trees(odd_docs(spark)).withColumn("__edits", drill_edits(F.col("text"), F.col("doc_id")))
    rows = apply_edits(trees.withColumn("before", F.col("text"))).collect()
    assert len(rows) == 13 and "shard" in rows[0].asDict()
    for r in rows:
        assert r["__n_tokens"] == whole(r["text"] or "")
        assert r["text"].endswith("'s end.\n") and (r["text"].startswith("Note: ") or len(r["before"] or "") < 21)


def test_void_edits_and_empty_table(spark):
    trees = build_trees(odd_docs(spark)).withColumn("__edits", F.lit(None).cast("array<struct<start:long,remove:long,insert:string>>"))
    rows = apply_edits(trees).collect()
    assert all(r["__n_encoded"] == 0 and r["__n_tokens"] == whole(r["text"] or "") for r in rows)
    assert build_trees(no_docs(spark)).count() == 0
