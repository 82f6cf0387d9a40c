"""Incremental mining against mining everything at once, and a count of what was redone."""

import pytest

from glossaloom.operators.extract import extract_signals
from glossaloom.operators.mining import mine_policies
from glossaloom.streaming.chapters import CHAPTER_SCHEMA
from glossaloom.streaming.mining import PolicyStream

FIRST = [
    ("n", 1, "Then Calron met Dominic. He saw Calron and Count Sinclair near Rondo Trading Company."),
    ("n", 2, "Again Carlon met Dominic. She saw Sinclair Count at Rondo Trading Company, but Calron left."),
    ("n", 3, "The guild of Perot sent Dominic away. So Perot slept."),
    ("m", 1, "Here Calron rests. There Tobias rests."), ("m", 2, "Once Tobias woke, Calron ran."),
]
SECOND = [("n", 4, "Later Tobias found Perot. With Tobias came Mirabel."), ("n", 5, "Now Mirabel and Tobias left. Then Tobiass stayed."), ("n", 6, "He saw Tobiass and Mirabel.")]
# A chapter sent again: its names vanish unless others hold them.
THIRD = [("n", 3, "Nobody of note came. So Mirabell slept beside Mirabell."), ("n", 7, "The old Mirabell and Perot spoke."), ("m", 3, "")]


def rows(mined):
    plain = lambda r: tuple(round(v, 9) if isinstance(v, float) else v for v in r)
    return [sorted((plain(r) for r in df.select(*sorted(df.columns)).collect()), key=repr) for df in (mined.policies, mined.forms, mined.evidence, mined.contexts)]


def at_once(spark, chapters):
    frame = spark.createDataFrame([(n, c, t) for (n, c), t in chapters.items()], CHAPTER_SCHEMA)
    totals = frame.groupBy("novel").count().withColumnRenamed("count", "total_chapters")
    return mine_policies(extract_signals(frame), totals)


def test_every_batch_gives_what_mining_all_gives(spark, tmp_path):
    stream, chapters = PolicyStream(spark, str(tmp_path)), {}
    for number, batch in enumerate((FIRST, SECOND, THIRD)):
        stream.advance(spark.createDataFrame(batch, CHAPTER_SCHEMA), number)
        chapters |= {(n, c): t for n, c, t in batch}
        expected = rows(at_once(spark, chapters))
        assert rows(stream.policies()) == expected
    done = {r.batch: r for r in stream.progress().collect()}
    # Only components with a new or lost name are clustered again: novel m and the names around Dominic stay.
    everything = sum(done[b].new_names - done[b].lost_names for b in done)
    assert done[0].clustered_names == done[0].new_names
    assert 0 < done[1].clustered_names < done[0].new_names + done[1].new_names and 0 < done[2].clustered_names < everything
    # A batch that is run again after a failure changes nothing.
    stream.advance(spark.createDataFrame(THIRD, CHAPTER_SCHEMA), 2)
    assert rows(stream.policies()) == expected


def test_a_stream_of_files(spark, tmp_path):
    source = str(tmp_path / "in")
    for batch in (FIRST, SECOND):
        spark.createDataFrame(batch, CHAPTER_SCHEMA).coalesce(1).write.mode("append").parquet(source)
    arriving = spark.readStream.schema(CHAPTER_SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    stream = PolicyStream(spark, str(tmp_path / "state"))
    with pytest.raises(ValueError):
        stream.policies()
    stream.follow(arriving, str(tmp_path / "check")).awaitTermination(300)
    assert rows(stream.policies()) == rows(at_once(spark, {(n, c): t for n, c, t in FIRST + SECOND}))
