"""The train and eval jobs, from files to parameters or to the equal error rate."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..operators import cepstra, sampling, scoring, train
from ..operators.augment import Masks
from ..operators.eer import equal_error_rate
from ..operators.encoders import Attention, Encoder, Lstm, Params
from ..session import stored
from ..sources import audio, manifest, models

log = logging.getLogger("voicegrid")


def encoder_of(cfg: Config) -> Encoder:
    m = cfg.model
    if m.use_transformer:
        return Attention(m.transformer.dim, m.transformer.num_encoder_layers, m.transformer.num_heads)
    return Lstm(m.lstm.hidden_size, m.lstm.num_layers, m.lstm.frame_aggregation_mean)


def speaker_encoder(spark: SparkSession, cfg: Config, load_from: str = "") -> tuple[Encoder, Params]:
    """The configured encoder with saved parameters, or with fixed initial ones."""
    encoder = encoder_of(cfg)
    params = encoder.init(cfg.model.n_mfcc, 0)
    if load_from:
        expected, params = {name: x.shape for name, x in params.items()}, models.load(spark, load_from)
        if (found := {name: x.shape for name, x in params.items()}) != expected:
            raise ValueError(f"{load_from} is of another encoder than the configuration's: {found}, not {expected}")
    return encoder, params


def features(utterances: DataFrame, cfg: Config) -> DataFrame:
    """(utt, features) of each distinct file of a manifest; the files are found and read on the executors, and no name comes to the driver.

    Files that can't be read are left out and warned about.
    """
    heads = stored(audio.heads(utterances), "heads")
    counts = heads.agg(F.count("*").alias("all"), F.count("error").alias("bad"), F.min_by(F.struct("utt", "error"), F.col("error").isNull()).alias("one")).first()
    if not counts["all"]:
        raise ValueError("the manifest is empty")
    if counts["bad"]:
        log.warning("%d of %d files can't be read, such as %s: %s", counts["bad"], counts["all"], *counts["one"])
    return cepstra.of_files(heads, cfg.model.n_mfcc).persist()


def lengths(table: DataFrame) -> DataFrame:
    return table.select("utt", F.size("features").alias("frames"))


def run_training(spark: SparkSession, cfg: Config) -> tuple[Params, DataFrame]:
    """Trains in ``train.num_processes`` barrier tasks, or fewer if there are fewer cores or triplets in a batch."""
    utterances = manifest.select(spark, cfg.data.train_csv, cfg.data.train_librispeech_dir)
    table = features(utterances, cfg)
    aug = cfg.train.specaug
    masks = Masks(aug.freq_mask_prob, aug.time_mask_prob, aug.freq_mask_max_width, aug.time_mask_max_width) if aug.use_specaug else None
    drawn = sampling.accepted_triplets(utterances, lengths(table), cfg.model.seq_len, cfg.train.num_steps * cfg.train.batch_size, "train")
    # Slots are numbered anew, so that each step has a full batch.
    kept = sampling.renumbered(drawn).select("i", "anchor", "pos", "neg")
    prepared = train.crops(kept, table, cfg.model.seq_len, masks)
    t = cfg.train
    params, losses = train.train(prepared, encoder_of(cfg), t.num_steps, t.batch_size, t.triplet_alpha, t.learning_rate, cfg.model.saved_model_path or None, t.save_model_frequency, encoder_of(cfg).init(cfg.model.n_mfcc, 0), t.num_processes)
    table.unpersist()
    if cfg.model.saved_model_path:
        plot = f"{cfg.model.saved_model_path.removesuffix(models.SUFFIX)}.losses.svg"
        log.info("loss curve in %s", save_loss_curve(losses, plot))
    return params, losses


def save_loss_curve(losses: DataFrame, path: str, width: int = 800, height: int = 400) -> str:
    """A line of losses by step as an SVG file, below the model; steps are thinned to the picture's width."""
    last = losses.agg(F.max("step")).first()[0]
    if last is None:
        points, most = [], 1.0
    else:
        column = F.floor(F.col("step") * (width - 1) / F.greatest(F.lit(last), F.lit(1)))
        rows = losses.groupBy(column.alias("x")).agg(F.avg("loss").alias("y")).orderBy("x").collect()  # one a picture column at most
        points, most = [(r["x"], r["y"]) for r in rows], max(r["y"] for r in rows) or 1.0
    line = " ".join(f"{x},{height - 1 - y / most * (height - 1):.1f}" for x, y in points)
    labels = f'<text x="4" y="14">{most:.4f}</text><text x="{width - 60}" y="{height - 4}">step {last if last is not None else "-"}</text>'
    svg = f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}"><polyline fill="none" stroke="black" points="{line}"/>{labels}</svg>\n'
    losses.sparkSession.createDataFrame([(svg,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return path


def run_eval(spark: SparkSession, cfg: Config) -> tuple[float | None, float | None]:
    utterances = manifest.select(spark, cfg.data.test_csv, cfg.data.test_librispeech_dir)
    if not cfg.model.saved_model_path:
        log.warning("no saved_model_path: the encoder has its initial parameters")
    encoder, params = speaker_encoder(spark, cfg, cfg.model.saved_model_path)
    table = features(utterances, cfg)
    full = cfg.eval.full_sequence_inference
    embeddings = stored(train.infer(table, encoder, params, cfg.model.seq_len, cfg.model.sliding_window_step, full), "embeddings")
    log.info("%d utterances have embeddings", embeddings.where("embedding is not null").count())
    drawn = sampling.accepted_triplets(utterances, lengths(table), 1 if full else cfg.model.seq_len, cfg.eval.num_triplets, "eval")
    found = equal_error_rate(scoring.trials(drawn, embeddings), cfg.eval.threshold_step).first()
    table.unpersist()
    log.info("equal error rate %s at threshold %s", found["eer"], found["threshold"])
    return found["eer"], found["threshold"]
