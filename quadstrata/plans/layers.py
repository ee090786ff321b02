"""Layers: folder names, their metadata, and which of them answer for an id."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone

from ..functions.times import from_unix
from .files import Store

NAME = re.compile(r"^(\d{8}-\d{6})_(?:(full)|(\d{11})_(diff|snapshot))$")
META = "meta.json"
RANK = {"full": 0, "snapshot": 1, "diff": 2}


@dataclass(frozen=True)
class Layer:
    id: int
    kind: str
    base: int | None = None
    zoom: int = 14
    meta: dict = field(default_factory=dict, compare=False)
    path: str = ""
    #: Folders, by id modulo this, of the tables that are looked up by key; 1: not split.
    parts: int = 1

    @property
    def timespan(self) -> int | None:
        """Seconds back to the base."""
        return None if self.base is None else self.id - self.base

    @property
    def start(self) -> datetime:
        return from_unix(self.id if self.base is None else self.base)

    @property
    def end(self) -> datetime:
        return from_unix(self.id)

    @property
    def name(self) -> str:
        return layer_name(self.id, self.kind, self.timespan)


def layer_name(id_: int, kind: str, timespan: int | None = None) -> str:
    stamp = from_unix(id_).strftime("%Y%m%d-%H%M%S")
    return f"{stamp}_full" if kind == "full" else f"{stamp}_{timespan:011d}_{kind}"


def parse_name(name: str) -> tuple[int, str, int | None] | None:
    """id, kind and timespan; None for a folder that isn't a layer."""
    m = NAME.match(name)
    if not m:
        return None
    try:
        moment = datetime.strptime(m[1], "%Y%m%d-%H%M%S").replace(tzinfo=timezone.utc)
    except ValueError:
        return None
    return int(moment.timestamp()), m[2] or m[4], None if m[2] else int(m[3])


def load(store: Store, path: str) -> list[Layer]:
    """All published layers below path, by id, then as they are preferred; folders without metadata aren't published."""
    found = []
    for name in store.folders(path):
        if parsed := parse_name(name):
            place = f"{path}/{name}"
            if store.exists(f"{place}/{META}"):
                d = json.loads(store.read(f"{place}/{META}"))
                found.append(Layer(parsed[0], parsed[1], d.get("base"), d["zoom"], d.get("meta", {}), place, d.get("parts", 1)))
    return sorted(found, key=lambda x: (x.id, RANK[x.kind], -(x.timespan or 0)))


def publish(store: Store, built: str, layer: Layer, path: str) -> Layer:
    """Write the metadata into the built folder, then move it to its place: a reader sees all of the layer or nothing.

    A folder of that name without metadata is the rest of a failed attempt and is replaced.
    """
    place = f"{path}/{layer.name}"
    if store.exists(f"{place}/{META}"):
        raise ValueError(f"there is a layer {layer.name} already")
    store.write(f"{built}/{META}", json.dumps({"id": layer.id, "kind": layer.kind, "base": layer.base, "zoom": layer.zoom, "meta": layer.meta, "parts": layer.parts}))
    if store.exists(place):
        store.remove(place)
    store.move(built, place)
    return replace(layer, path=place)


def at(layers: list[Layer], id_: int, smallest: bool = False) -> Layer | None:
    """Of the layers with one id the preferred (largest) or the finest."""
    same = [x for x in layers if x.id == id_]
    return same[-1 if smallest else 0] if same else None


def chain(layers: list[Layer], head: Layer, smallest: bool = False) -> list[Layer]:
    """head, its base, and so on to the first full layer."""
    out = [head]
    while out[-1].kind != "full":
        base = at(layers, out[-1].base, smallest)
        if base is None:
            raise ValueError(f"the base of {out[-1].name} is missing")
        out.append(base)
    return out


def ids(layers: list[Layer]) -> list[int]:
    return sorted({x.id for x in layers})


def get_on(layers: list[Layer], moment: int) -> int | None:
    """The first id at or after a moment; None past the last."""
    return next((i for i in ids(layers) if i >= moment), None)


def get_on_or_before(layers: list[Layer], moment: int) -> int | None:
    return next((i for i in reversed(ids(layers)) if i <= moment), None)


def previous(layers: list[Layer], id_: int) -> int | None:
    return next((i for i in reversed(ids(layers)) if i < id_), None)


def following(layers: list[Layer], id_: int) -> int | None:
    return next((i for i in ids(layers) if i > id_), None)
