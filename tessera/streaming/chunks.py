"""Chunks of sections whose units arrive over time, with the open chunk of each section as state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessera import schemas
from tessera.operators.chunking import FOLDED, Packer, numbered, schema, with_budget

UNIT = "source_id string, artifact_type string, section_id int, section_ref string, unit_no int, content string, last boolean"
#: The state store that state of this kind needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class OpenChunk(StatefulProcessor):
    """Units count from 0; those that arrive before their turn wait."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "upcoming int, number int, packer string")
        self.waiting = handle.getMapState("waiting", "unit_no int", "content string, last boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        source, kind, section, ref, most, overlap = key
        state = self.open.get() if self.open.exists() else (0, 0, "[[], 0, false]")
        upcoming, number = int(state[0]), int(state[1])
        if upcoming < 0:  # the section has ended
            return
        held, taken, seeded = json.loads(state[2])
        packer = Packer(int(most), int(overlap), [tuple(x) for x in held], taken, seeded)
        for pdf in rows:
            for r in pdf.itertuples():
                if r.unit_no >= upcoming:
                    self.waiting.updateValue((int(r.unit_no),), (r.content, bool(r.last)))
        out = []
        while upcoming >= 0 and self.waiting.containsKey((upcoming,)):
            unit, last = self.waiting.getValue((upcoming,))
            self.waiting.removeKey((upcoming,))
            found = packer.add(unit) + (packer.close() if last else [])
            out += [(source, kind, section, ref, number + i, *c) for i, c in enumerate(found, 1)]
            number, upcoming = number + len(found), -1 if last else upcoming + 1
        self.open.update((upcoming, number, json.dumps([packer.rows, packer.taken, packer.seeded]) if upcoming >= 0 else ""))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in FOLDED.split(", ")])

    def close(self) -> None:
        pass


def chunk_stream(units: DataFrame) -> DataFrame:
    """Chunks of a stream of units (`UNIT`): each is given out when the next unit has no room in it, a section's last one with its last unit.

    Repeated units are taken once, units behind the last are passed over. State is one open chunk for each section, and units that wait; of an ended
    section a mark stays. Needs the state store `STORE`.
    """
    keyed = with_budget(units).groupBy("source_id", "artifact_type", "section_id", "section_ref", "most", "overlap_words")
    folded = keyed.transformWithStateInPandas(statefulProcessor=OpenChunk(), outputStructType=schema(FOLDED), outputMode="Append", timeMode="None")
    return numbered(folded).to(schema(schemas.CHUNK))
