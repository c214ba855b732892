"""What devices remember of their readers, as keyed state: one document a reader, whatever versions devices bring.

Events are applied in their order. A document of this version that a device brings is taken over, fields it lacks are added
when they are first written, and fields that are unknown here stay. A document of a newer version is kept as it is, and
from then on nothing is written for that reader; anything else is replaced. State holds KEPT_EDITIONS editions a reader,
so a reader's state is bounded, and a batch touches its own readers only.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from broadsheet.functions import constants as K

VERSION = 1
EVENT = "reader_id string, at timestamp, kind string, date string, value string"
_OUT = "reader_id string, document string, applied int, refused int"


def kind_of(raw: str | None) -> tuple[str, dict]:
    """usable, foreign (of a newer version) or replaceable, and the document."""
    try:
        doc = json.loads(raw) if raw else None
    except ValueError:
        doc = None
    version = doc.get("schemaVersion") if isinstance(doc, dict) else None
    if not isinstance(version, int) or isinstance(version, bool) or version < VERSION:
        return "replaceable", {"schemaVersion": VERSION}
    return ("usable" if version == VERSION else "foreign"), doc


def applied(doc: dict, kind: str, date: str | None, value: str | None) -> dict:
    """A document after an event: viewed (a story), ended (an edition), interests (joined by commas) or theme."""
    out = dict(doc)
    if kind == "viewed" and date and value:
        viewed = {d: list(s) for d, s in out.get("viewed", {}).items()}
        viewed[date] = sorted({*viewed.get(date, []), value})
        keep = sorted(viewed, key=lambda d: (d != date, [-ord(c) for c in d]))[: K.KEPT_EDITIONS]  # its own edition, then the newest
        out["viewed"] = {d: viewed[d] for d in sorted(keep)}
    elif kind == "ended" and date:
        ended = {*out.get("ended", []), date}
        out["ended"] = sorted(ended, key=lambda d: (d != date, [-ord(c) for c in d]))[: K.KEPT_EDITIONS]
        out["ended"].sort()
    elif kind == "interests":
        out["interests"] = sorted({i for i in (value or "").split(",") if i in K.INTEREST_TOPICS})[: K.KEPT_INTERESTS]
    elif kind == "theme":
        out.pop("theme", None)
        if value in ("light", "dark"):
            out["theme"] = value
    return out


class Devices(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.document = handle.getValueState("document", "raw string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kind, doc = kind_of(self.document.get()[0] if self.document.exists() else None)
        done = refused = 0
        batch = pd.concat(list(rows)).sort_values(["at", "kind", "date", "value"], kind="stable", na_position="first")
        for r in batch.itertuples():
            text = lambda x: None if pd.isna(x) else x
            if kind == "foreign":
                refused += 1
            elif r.kind == "stored":
                brought, other = kind_of(text(r.value))
                if brought != "replaceable":
                    kind, doc = brought, other
                done += 1
            else:
                doc = applied(doc, r.kind, text(r.date), text(r.value))
                done += 1
        raw = json.dumps(doc, sort_keys=True)
        self.document.update((raw,))
        yield pd.DataFrame({"reader_id": [key[0]], "document": [raw], "applied": [done], "refused": [refused]})

    def close(self) -> None:
        pass


def device_documents(events: DataFrame) -> DataFrame:
    """A stream of EVENT -> each batch's readers with their document after it, and how many events were applied and refused.

    kind `stored` brings a device's raw document in value. The session must use the RocksDB state store
    (spark.sql.streaming.stateStore.providerClass).
    """
    return events.groupBy("reader_id").transformWithStateInPandas(Devices(), outputStructType=_OUT, outputMode="Update", timeMode="None")
