import duckdb
import numpy as np
from pyspark.sql import functions as F

from bizdata.llm import neighbours, quotations
from tests.compare import compare, connect

SCHEMA = "vec_id long, embedding array<float>, query_id string, score string"


def rows_of(n, seed=0, groups=6, width=24):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, width)) * 3
    return [(int(i * 7), [float(np.float32(x)) for x in centres[i % groups] + rng.normal(size=width)], "?", "?") for i in range(n)]


def brute(rows, k, is_query):
    own = {}
    for i, v, *_ in rows:
        if i is not None and v and len(v) == 24 and None not in v and np.isfinite(v).all() and any(v):
            own[i] = np.array(v, np.float64)
    ids = np.array(sorted(own))
    every = np.array([own[i] for i in ids])
    out = {}
    for q in ids[[is_query(i) for i in ids]]:
        distance = np.sqrt(((every - own[q]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, distance)) if ids[j] != q][:k]
        out[int(q)] = [(int(ids[j]), distance[j]) for j in order]
    return out


def check(spark, rows, k, least, **options):
    got = {}
    df = neighbours.search(spark.createDataFrame(rows, SCHEMA).repartition(3), lambda i: i % 5 == 0, k, **options)
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = brute(rows, k, lambda i: i % 5 == 0)
    assert got.keys() == {q for q, near in want.items() if near}
    hit = 0
    for q, near in got.items():
        assert [n[0] for n in near] == list(range(1, len(want[q]) + 1))
        assert near == sorted(near, key=lambda n: (n[2], n[1]))
        hit += len({n[1] for n in near} & {i for i, _ in want[q]})
        score = dict(want[q])
        assert all(abs(n[2] - score[n[1]]) < 1e-12 for n in near if n[1] in score)
    assert hit >= least * sum(map(len, want.values()))


def test_recall_and_ties(spark):
    rows = rows_of(900)
    same = [(20_000 + i, rows[5][1], "?", "?") for i in range(40)]  # equal vectors: ties go to the smaller id
    odd = [(1, None, "?", "?"), (5, [], "?", "?"), (10, [0.0] * 24, "?", "?"), (15, [float("nan")] + [1.0] * 23, "?", "?"), (25, [None] + [1.0] * 23, "?", "?"),
           (30_000, [1.0] * 7, "?", "?"), (None, rows[0][1], "?", "?"), rows[3]]
    check(spark, rows + same + odd, 10, 0.9)


def test_all_codes_within_the_radius_are_found():
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(500, 40))
    rotation = neighbours.Rotation(rows)
    index = neighbours.Index(rotation, np.arange(500), rows)
    for radius in (0, 3, 9, 17, 40):
        for i in range(20):
            want = np.flatnonzero(np.bitwise_count(index.codes ^ index.codes[i]) <= radius)
            assert index.within(index.codes[i], radius).tolist() == want.tolist()


def test_too_small_a_radius_is_made_up_for(spark):
    check(spark, rows_of(300, groups=300), 10, 1.0, radius=0)  # hardly two codes are equal


def test_few_or_no_rows(spark):
    check(spark, rows_of(4), 10, 1.0)
    assert neighbours.search(spark.createDataFrame([], SCHEMA), lambda i: i % 5 == 0).count() == 0
    assert neighbours.search(spark.createDataFrame([(0, [1.0, 2.0], "", "")], SCHEMA), lambda i: i % 5 == 0).count() == 0


TALK = [(1, 0, "a", "Hello there friend.\nHow are you?"), (1, 1, "b", "On Monday a wrote:\n> Hello there friend.\n\nHi!  I am fine"),
        (1, 2, "a", "> > Hello there, friend\n>> how are you\n> Hi! I am fine\nGood to hear"), (1, 3, "c", ">> nothing known\n> How are you?\nme too"),
        (1, None, "c", "> x"), (None, 2, "c", None), (1, 3, "c", ">> nothing known\n> How are you?\nme too"), (2, 0, "x", ""), (2, 1, None, "a\r\n> b\rc"),
        (2, 2, "y", "> > > c\n> a\n>c"), (3, 5, "z", "only > inside"), (2, 7, "y", "> later said"), (2, 9, "y", "later said")]


def test_quotes_lead_to_the_first_message_that_says_them(spark, duck=None):
    import duckdb

    df = spark.createDataFrame([(*r, "?", "?") for r in TALK], "conv_id long, turn long, role string, text string, hash string, level string")
    linked = quotations.link_quotes(df)
    got = {(r["conv_id"], r["turn"]): r for r in linked.collect()}
    assert got[1, 1]["reply_to"] == 0 and got[1, 1]["body"] == "Hi!  I am fine"
    assert got[1, 2]["reply_to"] == 1 and got[1, 2]["n_quoted"] == got[1, 2]["n_linked"] == 3
    assert got[1, 3]["reply_to"] == 0 and (got[1, 3]["n_quoted"], got[1, 3]["n_linked"]) == (2, 1)
    assert got[2, 2]["reply_to"] == 1 and got[2, 7]["reply_to"] == 2 and got[2, 7]["n_linked"] == 0
    assert got[None, 2]["body"] == "" and linked.count() == len(TALK)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", TALK)
    assert compare(con, linked, quotations.LINK_SQL) is None


def test_a_message_comes_after_the_one_it_answers(spark):
    df = spark.createDataFrame(TALK, "conv_id long, turn long, role string, text string")
    seen = set()
    for r in quotations.reply_order(quotations.link_quotes(df)).collect():
        assert r["reply_to"] is None or (r["conv_id"], r["reply_to"]) in seen
        seen.add((r["conv_id"], r["turn"]))
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert quotations.link_quotes(none).count() == 0


def test_plan_has_no_python(spark):
    df = spark.createDataFrame(TALK, "conv_id long, turn long, role string, text string")
    plan = quotations.reply_order(quotations.link_quotes(df))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))


def test_quotes_wrapped_anew_or_in_part_are_linked(spark):
    long = "The quick brown fox jumps over the lazy dog near the river bank while the old farmer sleeps under a tree"
    other = "Nobody knows what the weather will be like tomorrow in the mountains"
    talk = [(1, 0, "a", long), (1, 1, "b", other), (1, 2, "c", "something else"),
            (1, 3, "d", "> The quick brown fox jumps over the lazy\n> dog near the river bank while the old\n> farmer sleeps under a tree\nyes"),
            (1, 4, "e", "> ... what the weather will be like ...\nno idea"), (1, 5, "f", "> what the moon will be like\nhm"),
            (1, 6, "g", "> > The quick brown fox\n> > jumps over the lazy dog\n> no\n> idea\nok"), (2, 1, "a", "> jumps over the lazy dog near the river"),
            (1, 7, "h", "> something\n> else\nshort"), (1, 7, "h", "> something\n> else\nshort")]
    got = {(r["conv_id"], r["turn"]): (r["reply_to"], r["n_quoted"], r["n_linked"]) for r in quotations.link_quotes(spark.createDataFrame(talk, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1, 3] == (0, 3, 3)
    assert got[1, 4] == (1, 1, 1)
    assert got[1, 5] == (4, 1, 0)
    assert got[1, 6] == (4, 4, 4)
    assert got[1, 7] == (2, 2, 2)
    assert got[2, 1] == (None, 1, 0)


def test_turns_with_gaps(spark):
    """Without quotes a message answers the greatest earlier turn, however far; order and links stay those of SQL."""
    rows = [(1, t, "user", f"message {t}") for t in (30, 0, 10, 20, 20, 5000, -7)] + [(1, 6000, "user", "> message 10\nyes"), (2, 3, "user", None), (2, None, "user", "x"), (None, 1, "user", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    linked = quotations.link_quotes(df)
    got = {(r["conv_id"], r["turn"]): r["reply_to"] for r in linked.collect()}
    assert got == {(1, -7): None, (1, 0): -7, (1, 10): 0, (1, 20): 10, (1, 30): 20, (1, 5000): 30, (1, 6000): 10, (2, 3): None, (2, None): None, (None, 1): None}
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert compare(con, linked, quotations.LINK_SQL) is None
    order = [r["turn"] for r in quotations.reply_order(linked.where("conv_id = 1")).collect()]
    assert order == [-7, 0, 10, 20, 20, 30, 5000, 6000] or order.index(6000) > order.index(10)


def test_quotes_planted_into_the_given_conversations(spark, tmp_path):
    """The given messages hold no quotes: every third one here quotes lines of earlier ones, some of them nested."""
    base = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    earlier = base.select("conv_id", (F.col("turn") + 2).alias("turn"), F.regexp_replace("text", "(?m)^", "> ").alias("quote"))
    planted = base.join(earlier, ["conv_id", "turn"], "left").withColumn("text", F.when((F.col("turn") % 3 == 2) & F.col("quote").isNotNull(), F.concat_ws(
        "\n", F.lit("On Monday someone wrote:"), "quote", F.regexp_replace("quote", "(?m)^> ", ">> "), "text")).otherwise(F.col("text"))).drop("quote")
    planted.coalesce(1).write.parquet(str(tmp_path / "x"))
    next((tmp_path / "x").glob("*.parquet")).rename(tmp_path / "conversations.parquet")
    linked = quotations.link_quotes(spark.read.parquet(str(tmp_path / "conversations.parquet")))
    assert linked.where("n_linked > 0").count() > 5
    assert compare(connect(str(tmp_path)), linked, quotations.LINK_SQL) is None


def test_probes_are_flipped_bits():
    masks = neighbours.probes(2)
    assert len(masks) == 1 + 16 + 120 and masks[0] == 0 and len(set(masks.tolist())) == len(masks)
    assert all(bin(m).count("1") <= 2 for m in masks.tolist())
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(400, 40))
    index = neighbours.Index(neighbours.Rotation(rows), np.arange(400), rows)
    for radius in (0, 3, 9, 14, 40):
        for i in range(0, 400, 37):
            far = np.bitwise_count(index.codes ^ index.codes[i])
            assert index.within(index.codes[i], radius).tolist() == np.flatnonzero(far <= radius).tolist()


def test_a_query_id_that_repeats_takes_its_smallest_vector(spark):
    rows = [(i, v, "?", "?") for i, v, *_ in rows_of(60, seed=5)]
    rows += [(0, [9.0] * 24, "?", "?"), (0, [-9.0] * 24, "?", "?")]
    for seed in (1, 2):
        df = spark.createDataFrame(rows, SCHEMA).repartition(3 + seed)
        got = neighbours.search(df, lambda i: i == 0, k=3, sample_rows=40, radius=64).collect()
        data = np.array([v for i, v, *_ in rows if i != 0])
        ids = np.array([i for i, *_ in rows if i != 0])
        far = np.sqrt(((data + 9.0) ** 2).sum(1))
        assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"])] == ids[np.lexsort((ids, far))[:3]].tolist()
