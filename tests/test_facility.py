from emberline.operators import facility, spatial


def test_times_of_sites_are_dealt_out_and_not_shuffled_by_cell(spark):
    sites = spark.createDataFrame([(i, 51.3 + i * 0.003, -0.3 + i % 7 * 0.05) for i in range(40)], "candidate_id long, lat double, lon double")
    cells = spark.createDataFrame([(i, 1.0 + i % 3, 51.4 + i * 0.01, -0.2) for i in range(9)], "cell_id long, weight double, lat double, lon double").coalesce(1)
    matrix = spatial.travel_matrix(sites, cells)
    assert matrix.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism  # one task made all pairs
    times = facility.held(matrix.withColumnRenamed("drive_s", "t"))
    value = {(r.site_id, r.cell_id): (r.w, r.t) for r in times.collect()}
    assert len(value) == 360
    swaps = facility.swap_values(times, [3, 8, 20])
    plan = swaps._jdf.queryExecution().executedPlan().toString()
    assert "cell_id" not in "".join(x for x in plan.splitlines() if "Exchange hashpartitioning" in x)
    chosen = [3, 8, 20]
    for r in swaps.collect():
        own = [s for s in chosen if s != r.out_site] + [r.in_site]
        want = sum(value[s0, c][0] * min(value[s, c][1] for s in own) for s0 in (0,) for c in range(9)) / sum(value[0, c][0] for c in range(9))
        assert abs(r.value - want) < 1e-6
    for start in ((), (3, 8)):  # the best known so far is carried on
        step = list(start)
        while len(step) < 4:
            b = facility.gains(times, step).orderBy("cost", "site_id").first()
            step.append(b.site_id)
        assert facility.greedy(times, 4, start=start) == step
