import json
import os

import pytest
from pyspark.sql import functions as F

from tablewright.sources import delimited, sinks, storage
from tablewright.sources.sample import sample_customers

ROWS = "id{0}name{0}score{0}ok\n1{0}Åsa{0}1.5{0}True\n2{0}{0}NA{0}False\n3{0}x y{0}2{0}true\n"


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


@pytest.mark.parametrize("separator", [",", ";", "\t", "|"])
@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "latin-1"])
def test_separators_and_encodings(spark, tmp_path, separator, encoding):
    path = write(tmp_path / "in.csv", ROWS.format(separator), encoding)
    table, rejected = delimited.read_delimited(spark, path)
    assert [f.dataType.simpleString() for f in table.schema] == ["bigint", "string", "double", "boolean"]
    found = {r["id"]: (r["name"], r["score"], r["ok"]) for r in table.collect()}
    assert found == {1: ("Åsa" if encoding != "latin-1" else "إsa", 1.5, True), 2: (None, None, False), 3: ("x y", 2.0, True)}
    assert rejected.count() == 0


def test_arabic_code_page(spark, tmp_path):
    path = write(tmp_path / "in.csv", "رقم;اسم\n1;سلام\n2;دنيا\n", "cp1256")
    table, _ = delimited.read_delimited(spark, path)
    assert table.columns == ["رقم", "اسم"]
    assert [r["اسم"] for r in table.orderBy("رقم").collect()] == ["سلام", "دنيا"]


def test_a_character_cut_by_the_prefix_stays_utf8(spark, tmp_path):
    text = "a,b\n" + "é,1\n" * 9000
    assert delimited.sniff(spark, write(tmp_path / "in.csv", text)).encoding == "utf-8"


def test_quoted_newlines_and_quotes(spark, tmp_path):
    path = write(tmp_path / "in.csv", 'a,b\n1,"two\nlines"\n2,"say ""hi"""\n')
    table, rejected = delimited.read_delimited(spark, path)
    assert [tuple(r) for r in table.orderBy("a").collect()] == [(1, "two\nlines"), (2, 'say "hi"')]
    assert rejected.count() == 0


def test_long_and_short_rows(spark, tmp_path):
    path = write(tmp_path / "in.csv", 'a,b,c\n1,x,y\n2\n\n3,p,q,extra\n4,"u,v",w\n')
    table, rejected = delimited.read_delimited(spark, path)
    assert [tuple(r) for r in table.orderBy("a").collect()] == [(1, "x", "y"), (2, None, None), (4, "u,v", "w")]
    assert [r[0] for r in rejected.collect()] == ["3,p,q,extra"]


def test_duplicate_and_blank_headers(spark, tmp_path):
    path = write(tmp_path / "in.csv", "a,a,,a.1\n1,2,3,4\n")
    assert delimited.read_delimited(spark, path)[0].columns == ["a", "a.1", "Unnamed: 2", "a.1.1"]


def test_file_position_orders_rows(spark, tmp_path):
    path = write(tmp_path / "in.csv", "a,b\n" + "".join(f"{i},x\n" for i in (5, 3, 9, 1)))
    table, _ = delimited.read_delimited(spark, path, with_position=True)
    assert [r["a"] for r in table.orderBy(delimited.FILE_POSITION).collect()] == [5, 3, 9, 1]


def test_empty_text(spark, tmp_path):
    path = write(tmp_path / "in.csv", "")
    assert delimited.sniff(spark, path) is None
    with pytest.raises(ValueError):
        delimited.read_as_text(spark, path)


def test_null_tokens(spark):
    df = spark.createDataFrame([(t,) for t in (*delimited.NULL_TOKENS, "#NULL!", "kept")], "x string")
    assert delimited.nulls_from_tokens(df).filter("x IS NOT NULL").count() == 2
    assert delimited.nulls_from_tokens(df, delimited.EXTRA_NULL_TOKENS).filter("x IS NOT NULL").count() == 1


def test_write_options(spark, tmp_path):
    df = spark.sql("SELECT 2 AS k, DATE '2024-03-05' AS d UNION ALL SELECT 1, DATE '2024-03-04'")
    path = str(tmp_path / "out")
    sinks.write_delimited(df.coalesce(1), path, include_index=True, order_by=["k"], separator=";", date_format="dd.MM.yyyy")
    lines = sorted(r["value"] for r in spark.read.text(path).collect())
    assert lines == ["0;1;04.03.2024", "1;2;05.03.2024", "_row_pos;k;d"] or set(lines) == {
        "0;1;04.03.2024", "1;2;05.03.2024", "_row_pos;k;d"}
    with pytest.raises(ValueError):
        sinks.write_delimited(df, str(tmp_path / "other"), include_index=True)


def test_run_directory(spark, tmp_path):
    df = spark.range(20).selectExpr("id", "IF(id % 5 = 0, NULL, id * 1.0D) AS x")
    steps = [{"operation": "handle_missing_numeric", "column": "x", "parameters": {"method": "mean"}}]
    from tablewright.plans.steps import apply_with_audit

    cleaned, audit = apply_with_audit(df, steps)
    path = str(tmp_path / "run")
    sinks.write_run(path, df, cleaned, steps, audit=audit)
    assert sorted(os.listdir(path)) == ["audit", "cleaned", "pipeline", "profile", "report"]
    document = json.loads("\n".join(r["value"] for r in spark.read.text(f"{path}/pipeline").collect()))
    assert document["pipeline"] == steps and document["metadata"]["pipeline_length"] == 1
    assert spark.read.parquet(f"{path}/cleaned").filter("x IS NULL").count() == 0


def test_sample(spark):
    df = sample_customers(spark)
    row = df.agg(
        F.count("*").alias("n"), F.count_distinct("customer_id").alias("ids"),
        F.sum(F.col("income").isNull().cast("int")).alias("no_income"),
        F.avg("age").alias("age"), F.count_distinct("city").alias("cities"),
        F.avg(F.col("is_premium").cast("int")).alias("premium"),
    ).first()
    assert (row["n"], row["ids"], row["cities"]) == (1020, 1000, 4)
    assert 20 < row["no_income"] < 90 and 33 < row["age"] < 37 and 0.24 < row["premium"] < 0.36
    assert sample_customers(spark, 5000).count() == 5100


def test_shared_folder(spark, monkeypatch):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert storage.has_shared_folder(spark) == bool(named)
    assert storage.shared_folder(spark) == (named or storage._folder_of_this_process())


def test_stored_tables_keep_names_types_and_rows(spark):
    df = spark.sql("SELECT id AS `a b`, TIMESTAMP_NTZ '2024-01-01 00:00:00' AS `c.d`, IF(id = 1, NULL, 'x') AS e FROM range(3)")
    kept = storage.stored(df)
    assert kept.columns == df.columns and [f.dataType for f in kept.schema] == [f.dataType for f in df.schema]
    assert sorted(map(str, kept.collect())) == sorted(map(str, df.collect()))


def test_records_across_lines_files_and_splits(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for part in range(3):
        body = "".join(
            f'{part * 1000 + i},"first {i}\nsecond ""{i}""\n\nlast, {i}",{"x" if i % 2 else ""}\n' for i in range(400)
        )
        (folder / f"{part}.csv").write_text("id,note,flag\n" + body)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        table, rejected = delimited.read_delimited(spark, str(folder), with_position=True)
        rows = table.orderBy(delimited.FILE_POSITION).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["id"] for r in rows] == [p * 1000 + i for p in range(3) for i in range(400)]
    assert all(r["note"] == f'first {r["id"] % 1000}\nsecond "{r["id"] % 1000}"\n\nlast, {r["id"] % 1000}' for r in rows)
    assert all(r["flag"] == ("x" if r["id"] % 2 else None) for r in rows)
    assert rejected.count() == 0


def test_quoted_newlines_in_a_single_byte_encoding_with_bad_rows(spark, tmp_path):
    path = write(tmp_path / "in.csv", 'n;t\n1;"سلام\nدنيا"\n2;x;y\n3\n', "cp1256")
    table, rejected = delimited.read_delimited(spark, path)
    assert [tuple(r) for r in table.orderBy("n").collect()] == [(1, "سلام\nدنيا"), (3, None)]
    assert [r[0] for r in rejected.collect()] == ["2;x;y"]


def test_quotes_inside_unquoted_fields(spark, tmp_path):
    text = 'a,b,c\n1,5" pipe,x\n2,"two\nlines 3"" wide",y\n3,7",z\n4,"",w\n5,"q" tail,v\n'
    table, rejected = delimited.read_delimited(spark, write(tmp_path / "in.csv", text))
    assert rejected.count() == 0
    assert [tuple(r) for r in table.orderBy("a").collect()][:4] == [
        (1, '5" pipe', "x"), (2, 'two\nlines 3" wide', "y"), (3, '7"', "z"), (4, None, "w"),
    ]
    assert table.count() == 5


def test_bytes_far_from_the_start_decide_the_encoding(spark, tmp_path):
    path = write(tmp_path / "in.csv", "a,b\n" + "1,x\n" * 60_000 + "2,café\n", "latin-1")
    table, _ = delimited.read_delimited(spark, path)
    found = table.filter("a = 2").first()["b"]
    assert "�" not in found and len(found) == 4


def test_headers_of_all_files(spark, tmp_path):
    write(tmp_path / "a.csv", "a,b\n1,x\n")
    write(tmp_path / "b.csv", "b,a\ny,2\n")
    table, _ = delimited.read_delimited(spark, str(tmp_path))
    assert sorted(tuple(r) for r in table.collect()) == [(1, "x"), (2, "y")]
    write(tmp_path / "c.csv", "b,z\ny,2\n")
    with pytest.raises(ValueError):
        delimited.read_delimited(spark, str(tmp_path))


def test_header_names_differ_by_more_than_case(spark, tmp_path):
    assert delimited.read_delimited(spark, write(tmp_path / "in.csv", "a,A\n1,2\n"))[0].columns == ["a", "A.1"]


def test_infinite_numbers_are_numbers(spark, tmp_path):
    table, _ = delimited.read_delimited(spark, write(tmp_path / "in.csv", "a\n1.5\ninf\n-inf\n"))
    assert dict(table.dtypes) == {"a": "double"}


def plain_records(text, separator):
    """Records and rejected lines of one file, line by line, by the stated rules."""
    lines = text.split("\n")
    lines = lines[:-1] if lines[-1] == "" else lines

    def ends_open(line, inside):
        """State after a line."""
        at_start = not inside
        k = 0
        while k < len(line):
            c = line[k]
            if inside:
                if c == '"':
                    if line[k + 1 : k + 2] == '"':
                        k += 1
                    else:
                        inside = False
            elif at_start and c == '"':
                inside = True
            at_start = not inside and c == separator
            k += 1
        return inside

    records, held, at = [], [], 0
    for k, line in enumerate(lines):
        if not held:
            at = k
        held.append(line)
        if not ends_open("\n".join(held), False):
            records.append(("\n".join(held), False))
            held = []
    if held:
        records += [(line, ends_open(line, False)) for line in lines[at:]]
    return [r for r in records if r[0].strip(" ")]


@pytest.mark.parametrize("size", [40, 1 << 20])
def test_quotes_in_any_splits_equal_a_plain_reading(spark, tmp_path, size):
    import random

    rng = random.Random(size)
    pieces = ['"a', 'b"', '"', "x", ",", ",", "\n", "\n", '""', 'y"z', ',"', '",', " ", "long text here"]
    before, batch = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        expected = []
        for number in range(2):
            folder = tmp_path / f"set{number}"
            folder.mkdir()
            texts = ["id,note\n" + "".join(rng.choice(pieces) for _ in range(rng.randrange(60))) + "\n" for _ in range(3)]
            for k, text in enumerate(texts):
                (folder / f"{k}.csv").write_text(text)
            found = delimited.dialect(spark, str(folder), ",")
            carried = found.carried()
            rows = delimited._joined_lines(spark, str(folder), found.format, carried).select("text", delimited.OPEN).collect()
            expected = [r for text in texts for r in plain_records(text, ",")[1:]]
            assert sorted((r["text"], r[delimited.OPEN]) for r in rows) == sorted(expected), texts
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)


def test_unclosed_quote_keeps_the_rest_of_the_file(spark, tmp_path):
    path = write(tmp_path / "in.csv", "a,b\n0,\"two\nlines\"\n1,\"abc\n" + "".join(f"{i},x\n" for i in range(2, 102)))
    table, rejected = delimited.read_delimited(spark, path)
    assert table.count() == 101 and table.filter("a = 0").first()["b"] == "two\nlines"
    assert [tuple(r) for r in rejected.collect()] == [('1,"abc', delimited.NEVER_CLOSED)]
    # The last line alone, in one of two files.
    folder = tmp_path / "two"
    folder.mkdir()
    write(folder / "1.csv", "a,b\n1,x\n")
    write(folder / "2.csv", 'a,b\n2,y\n3,"z\n')
    table, rejected = delimited.read_delimited(spark, str(folder))
    assert sorted(tuple(r) for r in table.collect()) == [(1, "x"), (2, "y")] and [r[0] for r in rejected.collect()] == ['3,"z']


def test_blank_lines_and_other_separators(spark, tmp_path):
    table, _ = delimited.read_delimited(spark, write(tmp_path / "a.csv", "\n" * 1500 + " \na;b\n1;2\n\n3;4\n"))
    assert sorted(tuple(r) for r in table.collect()) == [(1, 2), (3, 4)]
    assert delimited.sniff(spark, write(tmp_path / "b.csv", "a^b\n1^2\n")).separator == "^"
    assert delimited.sniff(spark, write(tmp_path / "c.csv", "a:b\n1:2:3\n")).header == ("a:b",)  # not by all lines
    assert delimited.sniff(spark, write(tmp_path / "d.csv", "a b\n1:2\n"), ":").separator == ":"
    assert delimited.sniff(spark, write(tmp_path / "e.csv", " \n\n")) is None


def test_only_parts_of_cut_records_are_exchanged(spark, tmp_path):
    path = write(tmp_path / "in.csv", 'a,b\n1,"two\nlines"\n2,x\n')
    plan = delimited.read_as_text(spark, path)._jdf.queryExecution().executedPlan().toString()
    # Lines meet the states of their splits by broadcast; what is exchanged by a key are parts of records and states.
    assert plan.count("MapInArrow") == 2 and "BroadcastHashJoin" in plan
    keys = [x.split("hashpartitioning(")[1].split(")")[0] for x in plan.split("\n") if "Exchange hashpartitioning" in x]
    assert keys and all(k.startswith("file#") for k in keys)
