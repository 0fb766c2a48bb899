import corpus_pipeline as C
from tests.llm.test_decontam import brute as hits
from tests.llm.test_lines import brute as lines
from tests.llm.test_minhash import brute as groups


def test_stages_against_brute_force(spark, sf):
    """Every stage on what its predecessor kept."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = lambda df: [(x["doc_id"], x["text"]) for x in df.orderBy("doc_id").collect()]
    out = {}
    for name, stage in C.STAGES[:-1]:
        before, docs = rows(docs), C.cut(stage(spark, docs, sf), "test")
        out[name] = (before, rows(docs))
        assert docs.columns == spark.read.parquet(f"{sf}/documents.parquet").columns
    before, after = out["quality classifier"]
    assert set(after) <= set(before) and len(after) > 0.8 * len(before)
    before, after = out["line dedup"]
    assert dict(after) == {d: t for d, n, k, t in lines(before) if not k or t.strip()}
    before, after = out["MinHash near-dedup"]
    assert [d for d, _ in after] == [d for d, _, _, kept in groups(before, 5, 80) if kept]
    before, after = out["benchmark decontamination"]
    items = [(x["item_id"], x["text"]) for x in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert {d for d, _ in after} == {x[0] for x in hits(before, items) if not x[5]}
    packed = C.STAGES[-1][1](spark, docs, sf).collect()
    assert {x["doc_id"] for x in packed} == {d for d, _ in after}


def test_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        out = stage(spark, docs, sf)
        assert out.count() == 0


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1 if t is None else len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")


def kept(df):
    return sorted(((x["doc_id"], x["text"]) for x in df.collect()), key=str)


def test_rows_not_ids_are_deduplicated(spark, sf):
    text = "a quiet harbour town wakes before the boats come in from the northern banks"
    rows = [(7, text), (5, text), (5, text), (None, text), (5, "another text under the same id that has nothing in common"), (None, "x y z"), (None, "x y z"), (9, None), (9, None), (None, "")]
    got = C.near(spark, table(spark, rows), sf)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert kept(got) == sorted([(5, text), rows[4], (None, "x y z"), (9, None), (9, None), (None, "")], key=str)


def test_contaminated_rows_go_whatever_their_id(spark, sf):
    item = next(x["text"] for x in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if len(x["text"].split()) >= 12)
    clean = "words of no benchmark at all stand here in one row"
    rows = [(None, "so: " + item), (3, item), (3, clean), (None, clean), (4, None), (4, ""), (8, "w " * 300_000 + item)]
    assert kept(C.decontaminated(spark, table(spark, rows), sf)) == sorted([(3, clean), (None, clean), (4, None), (4, "")], key=str)


def test_lines_of_rows_without_id(spark, sf):
    one, two = "the first line of some length here", "and a second line that differs from it"
    rows = [(None, f"{one}\n{two}"), (4, one), (4, one), (None, two), (6, None), (None, "")]
    df = C.lines(spark, table(spark, rows).selectExpr("*", "1 as key", "2 as n_lines", "'z' as w").drop("n_lines"), sf)
    assert df.columns == ["doc_id", "text", "lang", "source", "n_chars", "key", "w"]
    got = kept(df)
    assert got.count((4, one)) == 2 and (6, None) in got and (None, "") in got
    assert sum((t or "").count(two) for _, t in got) == 1 and sum((t or "").count(one) for _, t in got) == 2


def test_long_texts_pass_the_filtering_stages(spark, sf):
    """A text of 60,000 words on one line, and one of 20,000 lines, with a near copy and a repeated line each."""
    wide = " ".join(f"word{i % 977}x{i}" for i in range(60_000))
    high = "\n".join(f"line {i} of a very long text with its own number {i * 7}" for i in range(20_000))
    rows = [(1, wide), (2, wide + " end"), (3, high), (4, high + "\nline 5 of a very long text with its own number 35"), (5, None)]
    assert C.quality(spark, table(spark, rows), sf).count() <= 5
    got = dict(kept(C.lines(spark, table(spark, [*rows[:1], *rows[2:]]), sf)))
    assert got[1] == wide and got[3] == high and 4 not in got
    assert [d for d, _ in kept(C.near(spark, table(spark, rows), sf))] == [1, 3, 5]


def test_pack_stage_takes_any_rows(spark, sf):
    rows = [(None, "a b"), (None, "a b"), (1, None), (1, None), (2, "w " * 50_000)]
    got = C.packed(spark, table(spark, rows), sf).collect()
    assert sum(x["doc_id"] is None for x in got) == 2 and sum(x["doc_id"] == 1 for x in got) == 2 and sum(x["length"] for x in got if x["doc_id"] == 2) > 50_000


def test_clashing_columns_pass_every_stage(spark, sf):
    text = "the ferry leaves the small harbour at nine and comes back before the evening tide"
    names = ["id", "key", "also", "n", "w", "ord", "rep", "label", "part", "rank", "bands", "item", "digest", "h", "named", "carried", "kept", "lines", "component_id"]
    df = table(spark, [(1, text), (2, text), (None, text + " again"), (3, None)])
    for n in names:
        df = df.withColumn(n, C.F.lit("x"))
    for name, stage in C.STAGES[:-1]:
        df = C.cut(stage(spark, df, sf), "clash")
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars", *names], name
    assert C.packed(spark, df, sf).count() == df.count()
