"""The message store: restarts, known files, order, purge in place."""

import os
import zipfile

import pytest

from tramline.sources import message_store as store


def packet(sent: str, *numbers: int, day: str = "20151124") -> str:
    one = lambda n: f'<Nachricht><Ist><Service IdBfEvaNr="1" IdZeit="{day}115400" IdZNr="{n}" Zielzeit="{day}172600"><ListZug><Zug Nr="{n}"><ListZE><ZE Typ="Ab"><Bf EvaNr="1"/><Zeit Soll="{day}120000"/></ZE></ListZE></Zug></ListZug></Service></Ist></Nachricht>'
    return f'<?xml version="1.0" encoding="utf-8"?>\n<Paket TOut="{sent}000"><ListNachricht>{"".join(map(one, numbers))}</ListNachricht></Paket>'


def put(path, text, at):
    path.write_text(text)
    os.utime(path, (at, at))


WHOLE = ("2015-11-24 00:00:00", "2015-11-25 00:00:00")


def numbers(df):
    return [r.trip.train_nr for r in df.collect()]


def test_ingest_knows_files_and_orders_by_time(spark, tmp_path):
    src, root = tmp_path / "in" / "deep", str(tmp_path / "store")
    src.mkdir(parents=True)
    assert store.ingest(spark, root, str(tmp_path / "in")) == 0 and store.read(spark, root).count() == 0
    # one time of sending: the older file goes first, whatever its name
    put(src / "b.xml", packet("20151124110000", 3, 4), 1000)
    put(src / "a.xml", packet("20151124110000", 5), 2000)
    put(src / "notes.txt", "no message", 1)
    with zipfile.ZipFile(src / "c.zip", "w") as z:
        z.writestr("2.xml", packet("20151124100000", 2))
        z.writestr("1.xml", packet("20151124100000", 1, 0))
    assert store.ingest(spark, root, str(tmp_path / "in")) == 3
    assert numbers(store.ordered(store.read(spark, root))) == [1, 0, 2, 3, 4, 5]
    assert store.ingest(spark, root, str(tmp_path / "in")) == 0
    put(src / "d.xml", packet("20151125130000", 6), 3000)
    assert store.ingest(spark, root, str(tmp_path / "in")) == 1
    assert numbers(store.ordered(store.read(spark, root))) == [1, 0, 2, 3, 4, 5, 6]
    assert numbers(store.read(spark, root, "2015-11-25")) == [6]


def test_ingest_that_dies_is_repeated(spark, tmp_path, monkeypatch):
    src, root = tmp_path / "in", str(tmp_path / "store")
    src.mkdir()
    put(src / "a.xml", packet("20151124110000", 1), 1000)
    with monkeypatch.context() as m:
        m.setattr(store, "commit", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.ingest(spark, root, str(src))
    assert store.read(spark, root).count() == 0
    assert store.ingest(spark, root, str(src)) == 1 and numbers(store.read(spark, root)) == [1]
    assert store.vacuum(spark, root) == 1 and numbers(store.read(spark, root)) == [1]
    old = store.manifest(spark, root)
    store.commit(spark, root, old, clock="2015-11-24 00:00:00")
    with pytest.raises(RuntimeError):
        store.commit(spark, root, old, clock="2015-11-23 00:00:00")


def test_forward_resumes(spark, tmp_path):
    src, root = tmp_path / "in", str(tmp_path / "store")
    src.mkdir()
    # local times are an hour later than UTC
    sent = {1: "100000", 2: "105959", 3: "110000", 4: "115959", 5: "140000", 6: "150000"}
    for n, t in sent.items():
        put(src / f"{n}.xml", packet(f"20151124{t}", n), 1000 - n)
    put(src / "other.xml", packet("20151124100500", 99, day="20160101"), 1)
    store.ingest(spark, root, str(src))
    out = {}

    def sink(df, begin, dies=None):
        out[begin] = numbers(df)
        if begin == dies:
            raise OSError("lost")

    ask = lambda to, f: store.forward(spark, root, to, *WHOLE, f)
    with pytest.raises(OSError):
        ask("2015-11-24 13:00:00", lambda df, b: sink(df, b, "2015-11-24 10:00:00"))
    assert out == {"2015-11-24 09:00:00": [1, 2], "2015-11-24 10:00:00": [3, 4]}
    assert store.manifest(spark, root)["clock"] == "2015-11-24 09:59:59"
    before = dict(out)
    assert ask("2015-11-24 13:00:00", sink) == 2  # the lost batch again, and the next
    assert out == before | {"2015-11-24 13:00:00": [5]} and store.manifest(spark, root)["clock"] == "2015-11-24 13:00:00"
    assert ask("2015-11-24 13:00:00", sink) == 0 and ask("2015-11-24 12:00:00", sink) == 0
    assert store.manifest(spark, root)["clock"] == "2015-11-24 13:00:00"
    assert ask("2015-11-25 00:00:00", sink) == 1
    assert out["2015-11-24 14:00:00"] == [6] and sorted(n for b in out.values() for n in b) == [1, 2, 3, 4, 5, 6]


def test_forward_skips_what_the_schedule_does_not_touch(spark, tmp_path):
    src, root = tmp_path / "in", str(tmp_path / "store")
    src.mkdir()
    put(src / "a.xml", packet("20151124110000", 1), 1000)
    store.ingest(spark, root, str(src))
    assert store.forward(spark, root, "2015-11-24 23:00:00", "2015-11-25 00:00:00", "2015-11-26 00:00:00", lambda df, b: None) == 0


def test_purge_in_place(spark, tmp_path):
    src, root = tmp_path / "in", str(tmp_path / "store")
    src.mkdir()
    for n, t in enumerate(("20151123120000", "20151124110000", "20151124120000", "20151125120000")):
        put(src / f"{n}.xml", packet(t, n), n)
    store.ingest(spark, root, str(src))
    opened = store.read(spark, root)
    data = store.manifest(spark, root)["data"]
    store.purge(spark, root, "2015-11-24 10:00:00")
    assert sorted(numbers(store.read(spark, root))) == [2, 3]
    # the day behind is not written again, and readers of before still see all
    assert [d for d in data if d[0] == "2015-11-25"] == [d for d in store.manifest(spark, root)["data"] if d[0] == "2015-11-25"]
    assert sorted(numbers(opened)) == [0, 1, 2, 3]
    assert store.ingest(spark, root, str(src)) == 0  # files stay known
    store.vacuum(spark, root)
    assert sorted(numbers(store.read(spark, root))) == [2, 3] and len(os.listdir(f"{root}/manifest")) <= 2
    store.purge(spark, root, "2016-01-01 00:00:00")
    assert store.read(spark, root).count() == 0
