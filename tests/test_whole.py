"""Cases of the review: queries that once did less than whole."""

from partloom import catalog


def letters(n):
    out = ""
    n += 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def test_excel_columns_have_no_last_one(spark, tmp_path):
    keys = [*range(1, 1001), 18277, 18278, 475253, 475254, 10**15]
    spark.createDataFrame([(k,) for k in keys], "s_suppkey bigint").write.parquet(str(tmp_path / "supplier.parquet"))
    got = {r.n: (r.col, r.ord) for r in catalog.QUERIES["excel_column_order"](spark, str(tmp_path)).collect()}
    cols = {k: "" if k % 17 == 3 else letters(k) for k in keys}
    order = sorted(keys, key=lambda k: (len(cols[k]) or 10000, cols[k], k))
    assert got == {k: (cols[k], i + 1) for i, k in enumerate(order)}
