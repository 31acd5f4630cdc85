"""Every operator and every pipeline stage over nulls, empty and long texts, ties, repeated rows, no rows, and columns called like the operators' own."""

import pytest

import corpus_pipeline as C
from tabulon.llm import embeddings, fuzzy, lines, mixing, packing, paragraphs, pii, quality, sharding, simhash

OWN = (
    "_row _k _s _n _t _y _id _doc _gone _copy _runs _f _kept id doc tie line lines h h1 h2 fp key keys part own node v w d n x y a b f g k row slot src size before nth words rank bucket "
    "gone spans base list home piece start length bins free component component_id place edge least links root near score limit target taken epoch times weight one upto end cap fingerprint shard total first"
).split()
TEXT = "one two three four five six seven eight nine ten eleven twelve"
ROWS = [
    (None, None, None), (None, TEXT, "s"), (None, TEXT, "s"), (1, None, "s"), (1, "", None), (1, TEXT, "t"), (1, TEXT, "t"), (2, " ", "s"), (3, "w " * 30_000, "s"), (4, "\n" * 5_000, "é"),
    (5, TEXT + "\n" + TEXT, "s"), (6, TEXT.upper(), "u"), (7, "a.b@c.de +1 (744) 555-2801", "u"), (8, "日本語 🙂", "u"),
]
OPERATORS = {
    "simhash": lambda d: simhash.near_duplicates(d), "keep_first": lambda d: simhash.keep_first(d, similarity=0.8), "lines": lambda d: lines.dedup_lines(d), "fuzzy": lambda d: fuzzy.compare_edits(d),
    "fingerprints": lambda d: fuzzy.fingerprints(d), "paragraphs": lambda d: paragraphs.repeated_paragraphs(d), "remove_repeats": lambda d: paragraphs.remove_repeats(d),
    "quality": lambda d: quality.score(d, quality.train(d, d.select("doc_id", (d["n"] > 0).cast("int").alias("quality")))), "packing": lambda d: packing.pack_documents(d), "mixing": lambda d: mixing.mix(d).taken(),
    "mixed": lambda d: mixing.mixed_documents(d), "pii": lambda d: pii.find_personal_data(d, pii.train(d)), "sharding": lambda d: sharding.assign_shards(d),
}
#: Operators with a row for each row, and those with the columns of the table.
ALL_ROWS = ("simhash", "lines", "fuzzy", "fingerprints", "remove_repeats", "quality", "mixing", "pii", "sharding")
SAME_COLUMNS = ("keep_first", "remove_repeats", "mixed")


def table(spark, rows):
    schema = "doc_id bigint, text string, source string, lang string, n_chars bigint, `dotted.name` int, " + ", ".join(f"{c} int" for c in OWN)
    return spark.createDataFrame([(*r, "en", len(r[1] or ""), 5, *range(len(OWN))) for r in rows], schema)


@pytest.mark.parametrize("name", OPERATORS)
def test_operators(spark, name):
    df = table(spark, ROWS)
    out = OPERATORS[name](df)
    got = out.collect()
    assert OPERATORS[name](table(spark, [])).count() == 0
    if name in ALL_ROWS:
        assert len(got) == len(ROWS)
    if name in SAME_COLUMNS:
        assert out.columns == df.columns and all(r["shard"] == OWN.index("shard") and r["dotted.name"] == 5 for r in got)


def test_embeddings(spark):
    schema = "vec_id bigint, embedding array<float>, " + ", ".join(f"{c} int" for c in OWN)
    rows = [(None, [1.0]), (1, None), (1, [1.0]), (2, [1.0]), (2, [1.0]), (3, []), (4, [0.0]), (5, [1.0, 2.0])]
    assert embeddings.near_duplicates(spark.createDataFrame([(*r, *range(len(OWN))) for r in rows], schema)).count() == len(rows)
    assert embeddings.near_duplicates(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("name", [n for n, _ in C.STAGES])
def test_stages(spark, tmp_path, name):
    spark.createDataFrame([(i, i % 2, 0) for i in range(9)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stage = dict(C.STAGES)[name]
    df = table(spark, ROWS)
    out = stage(spark, df, str(tmp_path))
    n = out.count()
    assert stage(spark, table(spark, []), str(tmp_path)).count() == 0
    if name != "packing":
        assert out.columns == df.columns and n
    else:
        assert n >= len(ROWS)
