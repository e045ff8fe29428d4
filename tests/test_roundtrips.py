"""Round trips over tables that the driver's own do not hold: repeated names, long numbers."""

import duckdb

from vellumry.plans import catalogue


def _same(spark, folder, query, tables, sql):
    """The query's rows over the folder equal those of the SQL."""
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    wanted = con.execute(sql).fetchall()
    found = catalogue.QUERIES[query](spark, str(folder))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, found.collect()), key=key) == sorted(wanted, key=key)


def test_balances_of_one_name_keep_their_order_and_digits(spark, tmp_path):
    duckdb.sql(f"""COPY (SELECT i::BIGINT AS c_custkey, 'Customer#' || (i % 3) AS c_name, (i % 2)::INTEGER AS c_nationkey,
                         CASE i % 4 WHEN 0 THEN 100.0 - i WHEN 1 THEN 9.125 + i WHEN 2 THEN 12345678.5 ELSE 0.1 + i / 3.0 END::DOUBLE AS c_acctbal, 'SEGMENT' || (7 - i % 7) AS c_mktsegment
                         FROM range(60) t(i) ORDER BY i) TO '{tmp_path}/customer.parquet'""")
    # the order that the query's SQL leaves open, said in full
    sql = catalogue.ORACLE_SQL["xlsx_numbers_roundtrip"].replace("ORDER BY c_name)", "ORDER BY c_name, c_custkey)")
    assert "c_custkey" in sql
    _same(spark, tmp_path, "xlsx_numbers_roundtrip", ["customer"], sql)


def test_files_are_made_once(spark, tmp_path):
    """Detection reads what made the files once, and still tells packages by their parts."""
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    books = catalogue._written(catalogue._nations(spark, "/root/testdata/sf0.001"), "xlsx")
    files = books.union(spark.createDataFrame([("p", "a.bin", None, bytearray(b"%PDF-1.4")), ("n", "b.txt", None, None)], books.schema))
    found = catalogue.convert.detect(files.mapInArrow(run, files.schema)).collect()
    assert sorted((r.doc_id, r.source) for r in found) == [*((str(n), "xlsx") for n in range(5)), ("n", "txt"), ("p", "pdf")]
    assert made.value == 7


def test_texts_of_one_row_group_go_to_many_tasks(spark, sf_dir):
    found = catalogue.QUERIES["pdf_roundtrip"](spark, sf_dir)
    assert found.groupBy(catalogue.F.spark_partition_id()).count().count() > 4
