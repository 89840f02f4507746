"""Realistic stand-ins for names, organisations, places and addresses; the same value always gets the same one in a conversation."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain, count

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.workers import on_workers
from .mask import MAX_ENTRIES

_M = (1 << 64) - 1

def _joined(heads: str, tails: str) -> list[str]:
    return [h + t for h in heads.split() for t in tails.split()]


# Our own pools. The first names of each are unlike one another; the made-up rest serves conversations that use those up.
GIVEN_FIRST = (
    "Arlo Benna Cato Dalia Edda Faro Gisel Hamo Inka Jorun Kelda Levin Mirka Nils Odalys Petra Quill Runa Sorin Tamsin Ulla Vigo Wanda Xenia Yara Zeno "
    "Ansel Birgit Cosmo Delphine Emeric Fenna Gunther Hedda Ivo Jolanta Kasimir Lisbet Magnus Noor Osric Pavla Quentin Rufus Signe Tobias Ursula Valdis Wilmot Xaver Yolanda Zdenka "
    "Aurelio Bettina Cyprian Dunja Eskil Florian Greta Hugo Isolde Jasper Katrin Lorenz Monika Nestor Ottilie Philippa Raoul Sabine Thaddeus Ulrich Verena Wolfram Yngve Zita "
    "Ambrose Bogdan Clemens Dagmar Ebba Frida Gideon Henrike Imogen Jarmila Knut Ludmila"
).split()
FAMILY_FIRST = (
    "Abbing Brandvold Corleigh Dunmore Elsted Farrow Grindal Holmsey Ivers Jasko Kestrel Lindqvist Marlow Norvell Ostrand Pellar Quennel Ridley Sandvik Thorne Uldall Vesper Whitlock Yarrow "
    "Aldous Bexley Cranmer Dovrak Eastvold Fjelde Garrick Havelka Ibsley Janosik Kirkland Lommel Mossberg Nyland Orczy Pryor Quimby Rosvall Stanhope Tremain Urquhart Vandermeer Wexford Yeats Zeller "
    "Ashdown Bjornson Chalmers Draycott Engstrom Fothergill Gadsby Hawthorn Iredale Jellicoe Kowal Langstrom Merrick Nordahl"
).split()
ORG_HEAD = "Amber Birch Cobalt Delta Ember Fjord Granite Harbor Indigo Juniper Keystone Lantern Meridian Nimbus Orchid Pinnacle Quartz Redwood Summit Tundra Umber Vertex Willow Zenith Aspen Basalt Cascade Dune Evergreen Falcon Glacier Horizon Ivory Jade Kingfisher Lagoon Maple Nova Onyx Prairie".split()
ORG_TAIL = "Analytics Foods Freight Instruments Labs Logistics Partners Textiles Ceramics Dynamics Energy Foundries Holdings Industries Motors Optics Packaging Robotics Shipping Tooling".split()
CITY_FIRST = (
    "Alderby Brookhaven Castleton Dunwick Eastmere Fairholm Greywater Highmoor Ironbridge Kingsbarrow Larkfield Millhaven Netherby Oakhurst Penrose Quarrington Ravensford Silverdale Thornbury Underhill "
    "Vinecroft Westerleigh Yewdale Ashcombe Blackrigg Coldbrook Deepdene Elmstead Foxcote Glenmoor Hazelwick Inverlea Juniperton Kelbrook Longmarsh Marshgate Northwold Otterburn Pinefort Rookwell"
).split()
GIVEN = GIVEN_FIRST + _joined("Ar Bel Bran Cas Cor Dal Dor Ed El Fal Fen Gar Gil Hal Il Jor Kel Lor Mar Ner Or Pel Quin Ros Sel Tam Ul Val Wen Xan Yor Zel", "ado aline amir andra areth aric asha avin ela enna erin evald ika ilde imund isa iven olan ona oris ulf wyn yla ystra")
FAMILY = FAMILY_FIRST + _joined("Ack Barn Bruns Cald Cros Dahl Den Eller Falk Gott Grim Hed Holt Jern Kar Kron Lang Lund Mal Mor Nord Nis Os Pil Rand Rost Sal Stern Thor Ul Vest Wald", "aker bakk beck borg bourne dorf feld garde gren haug hurst kamp land mann quist rud sen stad stein sson trup vall vik wold")
CITY = CITY_FIRST + _joined("Amber Bay Birch Clay Crow Dal Elder Fern Gold Hart Hawk Ing Jut Kin Lin Lock Mar Mill Nor Otter Pem Quin Red Rush Sand Stan Tad Ud Wal Win Yar Zen", "beck bridge burgh caster church cliff combe dale fell ford gate ham hithe holt hurst ley mere mouth port shaw stead thorpe wick worth")
ORG = [f"{head} {tail}" for head in ORG_HEAD for tail in ORG_TAIL]
STREET = "Acorn Beacon Cedar Dale Elm Foundry Garden Hill Ivy Jubilee Kiln Laurel Market Nutmeg Orchard Poplar Quarry Rowan Station Tanner".split()
STREET_KIND = "Lane Road Street Way Avenue Close".split()
SYLLABLE = _joined("b d f g h j k l m n p r s t v z", "a e i o u")


def mix(seed: int, n: int) -> int:
    """A well-mixed 64-bit number from a seed and a counter (splitmix64)."""
    z = seed ^ (n * 0x9E3779B97F4A7C15 & _M)
    z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & _M
    z = (z ^ z >> 27) * 0x94D049BB133111EB & _M
    return z ^ z >> 31


def pick(pool: list[str], seed: int, n: int) -> str:
    return pool[mix(seed, n) % len(pool)]


def each(first: list[str], pool: list[str], seed: int) -> Iterator[str]:
    """Picks of the first names, then every name of the pool from a place that follows from the seed, the first names before the rest."""
    yield from (pick(first, seed, n) for n in range(64))
    for part in (first, pool[len(first) :]):
        at = mix(seed, 64) % max(1, len(part))
        yield from part[at:]
        yield from part[:at]


def whole(kind: str, seed: int, n: int) -> str:
    if kind == "ORG":
        return f"{pick(ORG_HEAD, seed, n)} {pick(ORG_TAIL, seed, n + 1)}"
    if kind == "LOCATION":
        return pick(CITY_FIRST, seed, n)
    return f"{10 + mix(seed, n + 2) % 480} {pick(STREET, seed, n + 3)} {pick(STREET_KIND, seed, n + 4)}, {pick(CITY_FIRST, seed, n + 5)} {110_000 + mix(seed, n + 6) % 740_000}"


def coined(seed: int, n: int) -> str:
    """The n-th made-up name: at least four syllables, no name twice for one seed, without end."""
    size = 4
    while n >= len(SYLLABLE) ** size:
        n, size = n - len(SYLLABLE) ** size, size + 1
    left, out = (n * 0x9E3779B1 + mix(seed, 65)) % len(SYLLABLE) ** size, ""
    for _ in range(size):
        left, at = divmod(left, len(SYLLABLE))
        out += SYLLABLE[at]
    return out.capitalize()


def fnv(text: str) -> int:
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = (h ^ b) * 0x100000001B3 & _M
    return h


class Conversation:
    """Surrogates of one conversation. Words of the conversation itself are never used as a stand-in. With coins, names are made up once a pool is empty."""

    def __init__(self, seed: int, words: Iterable[str], coins: bool = False):
        self.seed, self.words, self.coins = seed, {w.lower() for w in words}, coins
        self.empty: set[str] = set()
        self.coined = count()
        self.used: set[str] = set()
        self.parts: dict[str, str] = {}
        self.known: dict[tuple[str, str], str] = {}

    def of(self, kind: str, raw: str) -> str | None:
        """The stand-in, None if every candidate is taken and none may be made up (the row must then be blocked)."""
        key = (kind, " ".join(raw.lower().split()))
        if key not in self.known:
            made = self._person(key[1], raw) if kind in ("PERSON", "NAME") else self._whole(kind, self.seed ^ fnv("\0".join(key)))
            if made is None:
                return None
            self.used.add(made.lower())
            self.known[key] = made
        return self.known[key]

    def _free(self, pool: str, candidates: Iterable[str], fits) -> str | None:
        """The first of candidates that fits. A pool that has none left never has one again, as taken names stay taken."""
        chosen = None if pool in self.empty else next(filter(fits, candidates), None)
        if chosen is None and pool:
            self.empty.add(pool)
        return chosen

    def _coined(self, fits, shape: str = "{}") -> str | None:
        return next(c for c in (shape.format(coined(self.seed, n)) for n in self.coined) if fits(c)) if self.coins else None

    def _person(self, norm: str, raw: str) -> str | None:
        fits = lambda c: c.lower() not in self.used and c.lower() not in self.words and c.lower() not in self.parts
        out = []
        for at, word in enumerate(norm.split()):
            if word not in self.parts:
                first, pool, name = (FAMILY_FIRST, FAMILY, "family") if at else (GIVEN_FIRST, GIVEN, "given")
                chosen = self._free(name, each(first, pool, self.seed ^ fnv(word) ^ at), fits) or self._coined(fits)
                if chosen is None:
                    return None
                self.parts[word] = chosen
                self.used.add(chosen.lower())
            out.append(self.parts[word])
        return " ".join(out)

    def _whole(self, kind: str, seed: int) -> str | None:
        fits = lambda c: c.lower() not in self.used and not set(c.lower().split()) <= self.words
        if kind == "LOCATION":
            return self._free(kind, each(CITY_FIRST, CITY, seed), fits) or self._coined(fits)
        made = (whole(kind, seed, n) for n in range(64))
        if kind == "ORG":
            return self._free(kind, chain(made, each(ORG, ORG, seed)), fits) or self._coined(fits, "{} " + pick(ORG_TAIL, seed, 65))
        return self._free("", chain(made, (whole(kind, seed, n) for n in range(64, 1 << 20)) if self.coins else ()), fits)


def _of_conversation(pdf: pd.DataFrame, coins: bool) -> pd.DataFrame:
    pdf = pdf.sort_values(["at", "raw"])
    conv = Conversation(fnv(str(pdf["conv_id"].iloc[0])), (w for words in pdf["words"] for w in words), coins)
    return pdf.assign(surrogate=[conv.of(k, r) for k, r in zip(pdf["kind"], pdf["raw"], strict=True)])[["conv_id", "kind", "raw", "surrogate"]]


def assign(entities: DataFrame, most: int | None = MAX_ENTRIES, coins: bool = False) -> DataFrame:
    """entities(conv_id, at, kind, raw, words): one row for each entity, words those of its turn -> conv_id, kind, raw, surrogate (null: blocked).

    Choices depend on those before them, so a conversation is one group. One with more than `most`
    entities is blocked as a whole, so no group grows with the data; without that limit (None) a group holds all its entities, but no
    texts. With coins, names are made up where a pool is empty, and nothing is blocked for that.
    """
    on_workers()
    schema = f"conv_id {entities.schema['conv_id'].dataType.simpleString()}, kind string, raw string, surrogate string"
    chosen = lambda rows: rows.groupBy("conv_id").applyInPandas(lambda pdf: _of_conversation(pdf, coins), schema)
    if most is None:
        return chosen(entities)
    over = entities.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).select("conv_id")
    blocked = entities.join(over, "conv_id", "left_semi").select("conv_id", "kind", "raw", F.lit(None).cast("string").alias("surrogate"))
    return chosen(entities.join(over, "conv_id", "left_anti")).unionByName(blocked)
