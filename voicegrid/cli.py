"""Command line: train, eval and generate_csv."""

from __future__ import annotations

import argparse
import logging

from . import config
from .session import local_session, ship
from .sources import manifest


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="voicegrid")
    p.add_argument("-m", "--mode", choices=("train", "eval", "generate_csv"), default="train")
    p.add_argument("-c", "--config", default="myconfig.yml")
    p.add_argument("--path_to_dataset", default="")
    p.add_argument("--audio_format", default=".flac")
    p.add_argument("--speaker_label_index", type=int, default=-2)
    p.add_argument("--output_csv", default="")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO)
    spark = ship(local_session())
    if args.mode == "generate_csv":  # needs no configuration
        n = manifest.generate_csv(spark, args.path_to_dataset, args.audio_format, args.output_csv, args.speaker_label_index)
        print(f"{n} utterances")
        return 0
    from .plans import jobs

    cfg = config.load(args.config)
    if args.mode == "train":
        _, losses = jobs.run_training(spark, cfg)
        losses.orderBy("step").show(20, False)
    else:
        print(*jobs.run_eval(spark, cfg))
    return 0
