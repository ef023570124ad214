"""Schemas, vocabulary and address builders of the conversation graph."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

BASE = "https://tarn.example/"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
PROV = "http://www.w3.org/ns/prov#"
OA = "http://www.w3.org/ns/oa#"
TYPE = RDF + "type"
REIFIES = RDF + "reifies"
STRING, INTEGER, DECIMAL, DATETIME, BOOLEAN, LANG = XSD + "string", XSD + "integer", XSD + "decimal", XSD + "dateTime", XSD + "boolean", RDF + "langString"

SPAN = "struct<start:bigint,end:bigint,kind:string>"
ACTION = "struct<id:string,kind:string,target:string>"
OUTCOME = "struct<id:string,first:string,lines:bigint,failed:boolean>"
EVENT = (
    "source string, conv_id string, pos bigint, event_id string, parent_id string, role string, timestamp string, text string, "
    f"text_provenance array<{SPAN}>, thinking string, model string, model_setting string, actions array<{ACTION}>, outcomes array<{OUTCOME}>"
)
SIGNAL = "map<string,struct<tag:tinyint,lex:string>>"
TEXT_TAG, INT_TAG, DECIMAL_TAG = 0, 1, 2
ANNOTATION = f"reader string, event_type string, ts string, event_id string, start bigint, end bigint, source_kind string, signal {SIGNAL}"
QUAD = "g string, s string, p string, o_kind string, o string, dt string, lang string, tt struct<s:string,p:string,o:string>"
QUAD_COLUMNS = ["g", "s", "p", "o_kind", "o", "dt", "lang", "tt"]
NOTE = "pos bigint, id string, ts string, text string, turns array<string>, model string"
SUMMARY = "block string, text string, model string, written string, wording string"

ID_CHARS = r"^[A-Za-z0-9_.:-]+$"
_SLUG = re.compile(r"[a-z0-9]+(-[a-z0-9]+)*")


class Names:
    """Addresses below ``{base}{squad}/{user}/``; the bare base when neither is set, an error when one is."""

    def __init__(self, base: str = BASE, squad: str | None = None, user: str | None = None):
        if bool(squad) != bool(user):
            raise ValueError("set both squad and user, or neither")
        for part in filter(None, (squad, user)):
            if not _SLUG.fullmatch(part):
                raise ValueError(f"not a slug: {part!r}")
        self.base, self.squad, self.user = base, squad, user
        self.root = f"{base}{squad}/{user}/" if squad else base

    def graph_term(self, kind: str, ident: Column) -> Column:
        """``{root}graph/<kind>/<id>``."""
        return F.concat(F.lit(f"{self.root}graph/{kind}/"), ident)

    def term(self, name: str) -> str:
        """An own vocabulary term."""
        return f"{self.base}graph/{name}"

    def owner(self) -> str | None:
        return f"{self.base}soul/Soul/{self.user}" if self.user else None


NAMES = Names()


def V(name: str) -> str:
    return NAMES.term(name)


# The predicates that projections emit.
TURN_PREDICATES = ["type", "turnId", "role", "parentTurn", "timestamp", "text", "model", "modelSetting"]
SENDER_PREDICATES = ["claimedSender", "claimedSenderPane", "claimedSenderSession", "claimedSenderSoul", "claimedSenderUser"]


def mangled(ident: Column) -> Column:
    """An id for a graph or transcript address: every other character becomes ``_``."""
    return F.regexp_replace(ident, r"[^A-Za-z0-9_-]", "_")


def checked_id(ident: Column) -> Column:
    """The id, or an error for a blank one or one with other characters; nothing is mended."""
    return F.when(ident.rlike(ID_CHARS), ident).otherwise(F.raise_error(F.concat(F.lit("not a turn id: "), F.coalesce(ident, F.lit("null")))))


def graph_bucket(g: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(g), F.lit(buckets)).cast("int")
