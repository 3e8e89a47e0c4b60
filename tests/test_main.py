"""All jobs in a row from staged files, as a user runs them."""

import pytest

from stratiform import __main__ as cli


@pytest.mark.parametrize("streamed", [False, True])
def test_from_files_to_reports(spark, write, envelope, flight, tmp_path, monkeypatch, streamed):
    monkeypatch.setattr(cli, "session", lambda name: spark)
    write("flights_2023-12-01-12-30-05.json", envelope(flight("A"), flight("B", live=None)) + "{broken\n")
    write("airlines_1.json", envelope({"id": 1, "airline_name": "Example"}))
    line = '100000001,"KRAKÓW-OBSERWATORIUM",2022,12,1,'
    write("k_d_t_12.csv", line + "3.5,,81.0,,2.1,,6.0,\n", encoding="cp1250")
    staged = write("k_d_12.csv", line + "5.0,,1.0,,3.5,,-1.0,,2.5,,W,0.0,8\n", encoding="cp1250")
    path = {name: str(tmp_path / name) for name in "flights airlines weather gold cells bad state out rain compact".split()}

    def run(*argv):
        cli.main([*argv])

    ingest = ["--staged", staged, "--silver", path["flights"], "--quarantine", path["bad"]]
    if streamed:
        run("flights-stream", *ingest, "--checkpoint", path["state"])
    else:
        run("flights", *ingest)
    run("dimension", "airlines", "--staged", staged, "--silver", path["airlines"], "--quarantine", path["bad"])
    run("weather", "--staged", staged, "--silver", path["weather"])
    run("gold", "--flights", path["flights"], "--weather", path["weather"], "--gold", path["gold"])
    run("serving", "--gold", path["gold"], "--cells", path["cells"])
    run("mean-delay", "--cells", path["cells"], "--output", path["out"])
    run("rain-against-delay", "--cells", path["cells"], "--output", path["rain"], "--airport", "WAW")
    run("compact", "--cells", path["cells"], "--target", path["compact"])

    read = spark.read.parquet
    assert read(path["flights"]).count() == 2 and read(path["airlines"]).count() == 1 and read(path["bad"]).count() == 1
    gold = read(path["gold"]).collect()
    assert [(r.flight_icao, r.arrival_rain, r.departure_rain) for r in gold] == [("A", 2.5, None)]
    assert [tuple(r) for r in read(path["out"]).collect()] == [("WAW", 3.0)]
    assert [tuple(r) for r in read(path["rain"]).collect()] == [(3, 0.0)]
    assert read(path["compact"]).count() == read(path["cells"]).count()
