import pytest
from pyspark.sql import functions as F

from voicegrid.operators import sampling
from voicegrid.sources import manifest


def _rows(df):
    return [(r["spk"], r["utt"]) for r in df.orderBy("pos").collect()]


def test_csv_keeps_two_fields_stripped(spark, tmp_path):
    lines = ["", "spk1,/path/to/utt1", "spk1, /path/to/utt2", "spk2 ,/path/to/utt3", "   ", "a,b,c", "only", "a,", ",b", "a,b,", '"x,y",z', '"q""r",t', "spk1,/path/to/utt1"]
    path = tmp_path / "m.csv"
    path.write_text("\n".join(lines))
    found = _rows(manifest.from_csv(spark, str(path)))
    assert found == [("spk1", "/path/to/utt1"), ("spk1", "/path/to/utt2"), ("spk2", "/path/to/utt3"), ("a", ""), ("", "b"), ("x,y", "z"), ('q"r', "t"), ("spk1", "/path/to/utt1")]
    assert manifest.from_csv(spark, str(path)).count() == 8


def test_csv_with_line_breaks_in_quotes(spark, tmp_path):
    (tmp_path / "d" / "id\n1").mkdir(parents=True)
    for name in ("id\n1/a.flac", "id\n1/b\"c,.flac"):
        (tmp_path / "d" / name).write_bytes(b"")
    out = tmp_path / "m.csv"
    assert manifest.generate_csv(spark, str(tmp_path / "d"), ".flac", str(out)) == 2
    assert _rows(manifest.from_csv(spark, str(out))) == [("id\n1", f"{tmp_path}/d/id\n1/a.flac"), ("id\n1", f'{tmp_path}/d/id\n1/b"c,.flac')]
    out.write_text('"a\nb",c\r\nx,"y\n\nz",w\nd,e\n')
    found = manifest.csv_rows(spark, str(out)).orderBy("pos").collect()
    assert [(r["n_fields"], r["spk"], r["utt"]) for r in found][:3] == [(2, "a\nb", "c"), (3, None, None), (2, "d", "e")]


def test_directory_takes_depth_three_only(spark, tmp_path):
    for name in ("61/70968/61-70968-0000.flac", "61/70968/61-70968-0001.flac", "121/1/121-1-0.flac", "121/1/x/deep-1.flac", "shallow/y-1.flac", "61/70968/notes.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"")
    found = manifest.from_directory(spark, str(tmp_path)).groupBy("spk").count().collect()
    assert {r["spk"]: r["count"] for r in found} == {"61": 2, "121": 1}


def test_generated_csv_is_read_back(spark, tmp_path):
    for name in ("id001/a.flac", "id001/b,c.flac", "id002/d.flac", "id002/e.wav"):
        (tmp_path / "d" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "d" / name).write_bytes(b"")
    out = tmp_path / "o" / "m.csv"
    assert manifest.generate_csv(spark, str(tmp_path / "d"), ".flac", str(out)) == 3
    text = out.read_text()
    assert text.splitlines()[0] == f"id001,{tmp_path}/d/id001/a.flac" and not text.endswith("\n")
    assert _rows(manifest.from_csv(spark, str(out))) == [("id001", f"{tmp_path}/d/id001/a.flac"), ("id001", f"{tmp_path}/d/id001/b,c.flac"), ("id002", f"{tmp_path}/d/id002/d.flac")]
    with pytest.raises(IndexError):
        manifest.generate_csv(spark, str(tmp_path / "d"), ".flac", str(out), 99)


def test_grouped_lists_in_order(spark):
    rows = spark.createDataFrame([("a", f"u{k}", k) for k in (2, 0, 1)], "spk string, utt string, pos long")
    assert manifest.grouped(rows, part=2).orderBy("part").select("utts").collect() == [(["u0", "u1"],), (["u2"],)]


def _manifest(spark, counts):
    rows = [(s, f"{s}{k}", k * (1 << 15)) for s, n in counts.items() for k in range(n)]
    return spark.createDataFrame(rows, "spk string, utt string, pos long")


def test_numbers_are_dense_over_parts(spark):
    found = sampling.numbered(_manifest(spark, {"a": 7, "b": 1})).where("spk = 'a'").orderBy("pos").collect()
    assert [r["at"] for r in found] == list(range(7))


def test_triplets_keep_their_rules_and_are_even(spark):
    many = sampling.triplets(_manifest(spark, {"a": 3, "b": 2, "c": 1}), sampling.slots(spark, 3000)).collect()
    assert len(many) == 3000
    for r in many:
        assert r["anchor"][0] == r["pos"][0] == r["pos_spk"] != r["neg_spk"] == r["neg"][0]
        assert r["anchor"] != r["pos"] and r["pos_spk"] in "ab"
    share = sum(r["pos_spk"] == "a" for r in many) / 3000
    assert abs(share - 0.5) < 0.04
    pairs = {}
    for r in many:
        if r["pos_spk"] == "a":
            pairs[r["anchor"], r["pos"]] = pairs.get((r["anchor"], r["pos"]), 0) + 1
    assert len(pairs) == 6 and max(pairs.values()) < 1.4 * min(pairs.values())


def test_too_few_speakers_give_none_and_repeats_may_meet(spark):
    assert sampling.triplets(_manifest(spark, {"a": 3}), sampling.slots(spark, 5)).count() == 0
    twice = spark.createDataFrame([("a", "u", 0), ("a", "u", 1), ("b", "v", 2)], "spk string, utt string, pos long")
    assert {(r["anchor"], r["pos"]) for r in sampling.triplets(twice, sampling.slots(spark, 5)).collect()} == {("u", "u")}


def test_whole_triplets_are_rejected(spark):
    m = _manifest(spark, {"a": 4, "b": 4})
    lengths = m.select("utt", F.when(F.col("utt") == "a0", 10).otherwise(200).alias("frames"))
    found = sampling.accepted_triplets(m, lengths, 100, 20)
    assert found.count() == 20 and not any("a0" in (r["anchor"], r["pos"], r["neg"]) for r in found.collect())
    with pytest.raises(ValueError):
        sampling.accepted_triplets(m, lengths, 1000, 5, rounds=2)


def test_triplets_as_rows_and_as_columns(spark):
    m = _manifest(spark, {"a": 4, "b": 4, "c": 1, "d": 3})
    rows = sampling.roles(m, sampling.slots(spark, 200))
    assert rows.count() == 600
    whole = sampling.together(rows)
    assert sorted(whole.collect()) == sorted(sampling.together(sampling.apart(whole)).collect()) and whole.count() == 200
    lengths = m.select("utt", F.when(F.col("utt").isin("a0", "c0"), 10).otherwise(200).alias("frames"))
    kept = {tuple(r) for r in whole.collect() if not {"a0", "c0"} & {r["anchor"], r["pos"], r["neg"]}}
    assert {tuple(r) for r in sampling.accepted(rows, lengths, 100).collect()} == {tuple(r) for r in sampling.accepted(whole, lengths, 100).collect()} == kept


def test_slots_that_repeat_and_speakers_without_a_name(spark):
    m = _manifest(spark, {"a": 3, "b": 2}).unionByName(spark.createDataFrame([(None, "x", 0), (None, "y", 1)], "spk string, utt string, pos long"))
    slots = sampling.slots(spark, 60)
    found = sampling.triplets(m, slots.unionByName(slots)).collect()
    assert len({r["i"] for r in found}) == len(found) and 0 < len(found) < 60
    assert all(r["pos_spk"] and r["neg_spk"] for r in found)
    assert sorted(found) == sorted(sampling.triplets(m, slots).collect())


def test_speakers_with_two_utterances_come_first(spark):
    found = sampling.speakers(_manifest(spark, {"a": 3, "b": 1, "c": 2, "d": 1, "e": 5})).orderBy("k").collect()
    assert [r["k"] for r in found] == list(range(5)) and {r["spk"] for r in found[:3]} == {"a", "c", "e"}


def test_draws_take_two_joins_by_number(spark):
    plan = sampling.roles(_manifest(spark, {"a": 3, "b": 2}), sampling.slots(spark, 5))._jdf.queryExecution().optimizedPlan().toString()
    # Numbers of speakers and of utterances; sizes, and the sums of the parts of either numbering.
    assert plan.count("Join ") == 2 + 3
