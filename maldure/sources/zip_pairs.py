"""Zip archives in pairs (labels and audio per domain) as a Python data source; a partition per domain and MEMBERS labels.

``spark.dataSource.register(ZipPairs)``, then ``spark.read.format("zip_pairs").option("domains", "all").load(folder)``.
The archives' directories are read to plan the partitions, and again in each; audio bytes are read only with the option ``audio``.
"""

from __future__ import annotations

import os
import zipfile
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# The domains, and the names that stand for all of them.
DOMAINS = ("D01", "D02", "D03", "D04")
ALL_NAMES = ("all", "validation", "valid")
#: Labels of one partition.
MEMBERS = 2000


def domain_ids(subset: str | None) -> list[str]:
    """The domains that a subset means."""
    return list(DOMAINS) if (subset or "all").lower() in ALL_NAMES else [subset.upper()]


class ZipPairs(DataSource):
    """Utterances of label and audio archives: domain, id, text, audio (null unless ``audio`` is ``true``)."""

    @classmethod
    def name(cls) -> str:
        return "zip_pairs"

    def schema(self) -> str:
        return "domain string, number int, id string, label_name string, audio_name string, text string, audio binary"

    def reader(self, schema) -> ZipPairsReader:
        return ZipPairsReader(self.options)


class ZipPairsReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.folder, self.with_audio = options["path"], options.get("audio", "false") == "true"
        self.domains, self.members = domain_ids(options.get("domains")), int(options.get("members", MEMBERS))

    def _names(self, domain: str) -> list[str]:
        names = [os.path.join(self.folder, f"{kind}_{domain}.zip") for kind in ("VL", "VS")]
        for name in names:
            if not os.path.exists(name):
                raise FileNotFoundError(name)
        return names

    @staticmethod
    def _labels(archive: zipfile.ZipFile) -> list[str]:
        return sorted(n for n in archive.namelist() if n.endswith(".txt"))

    def partitions(self) -> list[InputPartition]:
        out = []
        for domain in self.domains:
            with zipfile.ZipFile(self._names(domain)[0]) as labels:
                n = len(self._labels(labels))
            out += [InputPartition((domain, first)) for first in range(0, max(n, 1), self.members)]
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        domain, first = partition.value
        label_zip, audio_zip = self._names(domain)
        with zipfile.ZipFile(label_zip) as labels, zipfile.ZipFile(audio_zip) as sounds:
            texts = self._labels(labels)[first : first + self.members]
            audio = {os.path.splitext(n)[0]: n for n in sounds.namelist() if n.endswith(".wav")}
            missing = [n for n in texts if os.path.splitext(n)[0] not in audio]
            if missing:
                raise ValueError(f"{len(missing)} labels of {domain} have no audio, the first is {missing[0]}")
            for number, label in enumerate(texts, first):
                stem = os.path.splitext(label)[0]
                text = labels.read(label).decode("utf-8", "replace").strip()
                yield domain, number, stem, label, audio[stem], text, sounds.read(audio[stem]) if self.with_audio else None
