def _files(spark, sizes, prefix="src/f"):
    return spark.createDataFrame([("p", f"{prefix}{9 - i}.js", "x" * s) for i, s in enumerate(sizes)],
                                 "project_id string, path string, content string")


def _brute(sizes, target):
    parts, cur, cur_n = [], 0, 0
    for s in sizes:
        if cur_n and cur + s > target:
            cur, cur_n = 0, 0
            parts.append(None)
        cur += s
        cur_n += 1
        parts.append(len([p for p in parts if p is None]) + 1)
    return [p for p in parts if p is not None]


def test_greedy_packing(spark):
    from sitelens.operators.chunks import chunk_files
    got = [r.part_number for r in chunk_files(_files(spark, [10, 20, 5, 40, 1]), 30).orderBy("file_order").collect()]
    assert got == [1, 1, 2, 3, 4]


def test_five_files_three_parts(spark):
    from sitelens.operators.chunks import chunk_files
    out = chunk_files(_files(spark, [10_000] * 5), 25_000).collect()
    assert {r.total_parts for r in out} == {3} and len(out) == 5


def test_random_packing_matches_fold(spark):
    import random
    from sitelens.operators.chunks import chunk_files
    rnd = random.Random(5)
    sizes = [rnd.randint(0, 60) for _ in range(9)]
    got = [r.part_number for r in chunk_files(_files(spark, sizes), 50).orderBy("file_order").collect()]
    assert got == _brute(sizes, 50)


def test_fixture_order_one_part(audit):
    from sitelens.operators.chunks import chunk_files
    out = chunk_files(audit.sources).where("project_id = 'bakery'").orderBy("file_order").collect()
    assert [r.path.split("/")[-1] for r in out] == ["index.jsx", "App.jsx", "Order.jsx", "Hours.jsx", "Front.jsx"]
    assert {r.total_parts for r in out} == {1}
