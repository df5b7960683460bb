"""Roll-up of a file's tracks to one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _one_codec(codecs: Column, none: str) -> Column:
    return F.when(F.size(codecs) == 1, F.get(codecs, F.lit(0))).when(F.size(codecs) == 0, none).otherwise("multiple")


def roll_up(tracks: DataFrame, key: str, order: list[str]) -> DataFrame:
    """acodec, anch, arate, asbits, asubformat, vcodec, width, height of each key from rows of tracks.

    tracks has type (audio or video), codec, subformat, width, height, channel_count, sample_rate and
    sample_size. One audio track gives all its values (codec `?` if unknown); several give only the one known
    codec, or `multiple`, also if none is known. Several video tracks of one size count as the first of
    them in `order`; of unlike sizes they give the one known codec, `multiple`, or `?`, and no size. Empty codecs are
    unknown. One aggregate: no list of tracks is gathered.
    """
    audio, video = F.col("type") == "audio", F.col("type") == "video"
    known = F.when(F.col("codec") != "", F.col("codec"))
    dimensions = F.struct(F.coalesce("width", F.lit(-1)), F.coalesce("height", F.lit(-1)))
    one = lambda c: F.max(F.when(audio, F.col(c))).alias(f"a_{c}")
    first = F.min_by(F.struct("codec", "width", "height"), F.when(video, F.struct(*order)))
    rolled = tracks.groupBy(key).agg(
        F.count_if(audio).alias("n_audio"), F.count_if(video).alias("n_video"),
        F.collect_set(F.when(audio, known)).alias("audio_codecs"), F.collect_set(F.when(video, known)).alias("video_codecs"),
        F.count_distinct(F.when(video, dimensions)).alias("n_dimensions"), first.alias("first"), *(one(c) for c in ("codec", "subformat", "channel_count", "sample_rate", "sample_size")),
    )
    single = lambda c: F.when(F.col("n_audio") == 1, F.col(f"a_{c}"))
    same = F.col("n_dimensions") == 1
    return rolled.select(
        key,
        F.when(F.col("n_audio") == 1, F.coalesce("a_codec", F.lit("?"))).when(F.col("n_audio") > 1, _one_codec(F.col("audio_codecs"), "multiple")).alias("acodec"),
        single("channel_count").alias("anch"), single("sample_rate").alias("arate"), single("sample_size").alias("asbits"), single("subformat").alias("asubformat"),
        F.when((F.col("n_video") > 0) & same, F.coalesce("first.codec", F.lit("?"))).when(F.col("n_video") > 1, _one_codec(F.col("video_codecs"), "?")).alias("vcodec"),
        F.when(same, F.col("first.width")).alias("width"), F.when(same, F.col("first.height")).alias("height"),
    )
