"""What must not grow with the table: memory of a worker, rows of one task; and odd texts that small tables lack."""

import pyarrow as pa
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import vocabulary


def test_workers_hold_few_tokens(spark):
    texts = ["word " * 50, None, "", "Straße_x some " * 9, "naïve " * 7]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5), pa.int64()), pa.array(texts)], ["page", "text"])
    taken = []

    def rows(text):
        for j, run in enumerate(T.runs_of(text)):
            taken.append(run)
            yield (j, *run)

    out = vocabulary.streamed(iter([batch]), ["page"], vocabulary.TOKEN, rows, most=8)
    first = next(out)
    assert first.num_rows == 8 and len(taken) == 8  # the rest of the text is not yet looked at
    rest = list(out)
    assert max(b.num_rows for b in rest) <= 8
    got = [(r["page"], r["ordinal"], r["start"], r["end"], r["start_byte"], r["end_byte"], r["observed"]) for b in (first, *rest) for r in b.to_pylist()]
    assert got == [(i, j, *run) for i, t in enumerate(texts) for j, run in enumerate(T.letter_runs(t or ""))]


def test_unknown_tokens_span_batches(spark):
    texts = [(1, "x", "alpha beta gamma " * 9000), (2, "y", None), (3, "z", "délta ALPHA")]
    pages = spark.createDataFrame(texts, "page long, book string, text string")
    words = spark.createDataFrame([("beta",)], "key string")
    got = vocabulary.unknown_in(spark, pages, words).groupBy("page", "book", "key").agg(F.count("*").alias("n"), F.max("ordinal").alias("last")).collect()
    assert sorted(map(tuple, got)) == [(1, "x", "alpha", 9000, 26997), (1, "x", "gamma", 9000, 26999), (3, "z", "alpha", 1, 1), (3, "z", "délta", 1, 0)]


ODD = ["", " ", "\n\t", None, "a", "`", "``", "Naïve café 🙂\r\nend", "word " * 3000, "plain text"]


def odd_tables(spark, folder):
    """A folder with 200 documents of odd texts, in turn."""
    rows = [(i, ODD[i * 7 % len(ODD)], f"src{i % 3}") for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return str(folder)


def same_as_sql(spark, name, folder):
    import duckdb

    import __spark_entry__ as entry

    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    got = entry.queries()[name](spark, folder)
    want = db.sql(f"SELECT {', '.join(got.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    key = lambda r: tuple(map(repr, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_page_presence_on_blank_texts(spark, tmp_path):
    same_as_sql(spark, "page_presence", odd_tables(spark, tmp_path))


def test_visible_text_of_empty_texts(spark, tmp_path):
    same_as_sql(spark, "visible_text", odd_tables(spark, tmp_path))


def test_handoff_guards_share_one_join(spark, monkeypatch):
    """Blocks of a few rows against plain Python; ids are dealt out once a side."""
    import random

    from pagewright.operators import review

    monkeypatch.setattr(review, "BLOCK_ROWS", 7, raising=False)
    r = random.Random(5)
    source = [(f"f{i}", i, f"o{i % 5}", None) for i in range(300)]
    back = {file: [[id_, old, "yes"] for id_, p, old, _ in source if p % 3 == file] for file in range(3)}
    for rows in back.values():
        for _ in range(6):
            i = r.randrange(len(rows) - 1)
            rows[i], rows[i + 1] = rows[i + 1], rows[i]
        rows[r.randrange(len(rows))][1] = "changed"
        del rows[r.randrange(len(rows))]
        rows.insert(r.randrange(len(rows)), list(rows[r.randrange(len(rows))]))
        rows.insert(r.randrange(len(rows)), [f"x{len(rows)}", "o", None])
        rows.append([f"x{len(rows)}", "o", None])
    batches = [(file, 2**33 + n * 9 + n % 4, *row) for file, rows in back.items() for n, row in enumerate(rows)]
    batches.sort(key=lambda b: r.random())
    place, want = {id_: (p, old) for id_, p, old, _ in source}, []
    seen = [b[2] for b in batches]
    for file in back:
        before = None
        for _, _, id_, old, _ in sorted(b for b in batches if b[0] == file):
            p, was = place.get(id_, (None, None))
            want += [("unknown finding", id_)] * (p is None) + [("unauthorised edit", id_)] * (p is not None and was != old)
            want += [("finding order changed", id_)] * (p is not None and before is not None and p <= before)
            before = p
    want += [("duplicate finding", i) for i in set(seen) if seen.count(i) > 1] + [("missing finding", i) for i in place if i not in seen]
    bad = review.merge_guards(spark.createDataFrame(source, "id string, position long, observed string, status string"), spark.createDataFrame(batches, "file long, ordinal long, id string, observed string, status string"), ("status",))
    assert bad._jdf.queryExecution().toString().split("== Physical Plan ==")[1].count("hashpartitioning(id") == 2
    assert sorted(map(tuple, bad.collect())) == sorted(want) and len({rule for rule, _ in want}) == 5


def test_eligibility_moves_no_rows(spark):
    """Most findings have no approved word: they must not meet in one task of a join."""
    from pagewright.operators import review

    rows = [(f"f{i}", "word", *("doesn't nein Straße neu neu".split()[i % 5], "approved")[: 2 if i % 4 == 0 else 0]) if i % 4 == 0 else (f"f{i}", "word", "neu" if i % 4 == 1 else None, None) for i in range(400)]
    found = spark.createDataFrame(rows, "id string, observed string, proposed string, status string")
    lexicon = spark.createDataFrame([("nein",), ("strasse",), ("nein",)], "key string")
    want = sorted((i, o, p, s, p is None and s is None, s == "approved" and p == "neu") for i, o, p, s in rows)
    few, many = review.eligibility(found, lexicon), review.eligibility(found, lexicon, limit=1)
    columns = ["id", "observed", "proposed", "status", "eligible", "corrected_admissible"]
    assert sorted(map(tuple, few.select(columns).collect())) == want == sorted(map(tuple, many.select(columns).collect()))
    assert "hashpartitioning" not in few._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_word" in many._jdf.queryExecution().toString() and many.count() == 400


def test_listed_inventory_passes_ids_through(spark):
    """A common form spans many batches; its ids are a digest of all of them in order, and no task holds their list."""
    import hashlib
    import random

    rows = [(("common", "Rare", "Common", "other")[i % 7 if i % 7 < 4 else 0], 1000 - i, f"id{i}") for i in range(1000)] + [("null", 1, None), ("null", 0, "x"), ("null", 2, ""), ("none", 5, None)]
    random.Random(1).shuffle(rows)
    found = spark.createDataFrame([(o.lower(), *r) for r in rows if (o := r[0])], "key string, observed string, order long, id string")
    want = {}
    for observed, _, id_ in sorted(rows, key=lambda r: r[1]):
        word, n, ids = want.get(observed.lower(), (observed, 0, []))
        want[observed.lower()] = word, n + 1, ids + [id_] * (id_ is not None)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)
    try:
        out = vocabulary.listed_inventory(found)
        assert "collect_list" not in out._jdf.queryExecution().executedPlan().toString()
        got = sorted(map(tuple, out.collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert got == sorted((k, word, n, hashlib.md5(",".join(ids).encode()).hexdigest()) for k, (word, n, ids) in want.items())


def test_dealt_tables_are_joined_where_they_lie(spark, tmp_path):
    """The hand-off's guards deal out nothing by id; its table leaves no name in the catalog."""
    from pagewright.operators import review
    from pagewright.plans import queries

    spark.createDataFrame([(i, "alpha beta gamma", f"src{i % 2}") for i in range(40)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("beta",)], "text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    source, proposals, verdicts = queries._handoff(spark, str(tmp_path))
    assert source.count() == 80 and not [t for t in spark.catalog.listTables() if t.name.startswith("pagewright")]
    proposed, reviewed, guards = review.join_all(source, proposals, verdicts)
    for df in (proposed, reviewed, *guards):
        assert "hashpartitioning(id" not in df._jdf.queryExecution().executedPlan().toString()
        assert df.count() == (80 if "observed" in df.columns else 0)
