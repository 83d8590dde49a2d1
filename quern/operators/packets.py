"""Packets of a dialogue: parts with payloads, moves with evidence, profiles, warrants and content ids, checked in the row.

``packets`` has ``packet``, ``move``, ``parents`` (texts ``<id>#move=<move>``), ``body`` (``kind``, JSON ``payload``) and, where used, ``warrant``
(``kind``, ``cid``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.json import items_at, keys_at, kind_at, parsed, string_at
from quern.functions.values import bind

from .protocols import COLLAB, MOVES, matching_profiles

# The part book, with the class by which a part is shown and the authority it has.
PART_BOOK = (
    ("Given", "data", "data"), ("Frame", "frame", "normative"), ("Call", "structural", "callable"), ("Weave", "structural", "normative"),
    ("Check", "structural", "normative"), ("Evidence", "evidence", "evidence"), ("Review", "review", "evidence"), ("Vote", "vote", "evidence"),
    ("Patch", "patch", "normative"), ("Fetch", "fetch", "callable"), ("Return", "return", "normative"), ("Receipt", "receipt", "evidence"),
    ("Attest", "evidence", "evidence"), ("Extension", "extension", "data"),
)
# The frame book: name, prefix of what is rendered, template, and kinds of the holes.
FRAME_BOOK = (
    ("use", "Use ", "the referenced context {resource}.", {"resource": "token"}),
    ("inform", "Note ", "{fact}.", {"fact": "token"}),
    ("proposal", "You MUST ", "produce the requested proposal.", {}),
    ("answer", "Note ", "answer the parent packet.", {}),
    ("produce-artifact", "You MUST ", "produce {what} for {target}.", {"what": "token", "target": "token"}),
    ("require", "You MUST ", "{rule}.", {"rule": "token"}),
    ("forbid", "You must NEVER ", "{rule}.", {"rule": "token"}),
    ("prefer", "Prefer to ", "{choice}.", {"choice": "token"}),
    ("return", "Return ", "{shape}.", {"shape": "token"}),
    ("check", "Check ", "{path}.", {"path": "path"}),
    ("explain", "Note ", "{text}.", {"text": "prose"}),
)
# Fields of what collaborators write, with their kinds.
COLLAB_FIELDS = {
    "Review": {"target": "string", "body": "string"},
    "Vote": {"target": "string", "scores": "list"},
    "Patch": {"parent-cid": "string", "target": "string", "replacement": "any"},
    "Evidence": {"source": "string", "body": "string"},
    "Receipt": {"status": "string", "refs": "texts"},
    "Attest": {"subject": "string", "claim": "string", "evidence": "texts"},
}
SCORE_FIELDS = {"axis": "string", "value": "number", "reason": "string"}
ROW_FIELDS = ("slot", "head", "roles")
ARGUMENT_FIELDS = ("name", "codec", "media", "content-id", "fenced")
#: A text without white space and braces, all ASCII.
TOKEN = r"^[\x00-\x08\x0E-\x1F\x21-\x7A\x7C\x7E\x7F]+$"


def _path(name: str) -> str:
    return f'$["{name}"]'


def _unknown(v: Column, allowed, label: str) -> Column:
    more = F.array_except(keys_at(v), F.array(*[F.lit(x) for x in allowed]))
    return bind(more, lambda x: F.when(x.isNull(), f"{label} must be a map").when(F.size(x) > 0, F.concat(F.lit(f"unknown {label} field "), F.get(x, 0))))


def _first(items: Column, reason) -> Column:
    return F.get(F.array_compact(F.transform(items, reason)), 0)


def hole_reason(slots: Column, name: str, kind: str) -> Column:
    """What is wrong with the value of a hole: a token, a path of tokens, or prose."""
    found, text = kind_at(slots, _path(name)), string_at(slots, _path(name))
    if kind == "prose":
        return F.when(found != "string", f"hole {name} expects prose")
    if kind == "path":
        steps = items_at(slots, _path(name))
        bad = F.exists(steps, lambda x: ~F.coalesce(string_at(x, "$").rlike(TOKEN), F.lit(False)))
        return F.when(~(F.size(steps) > 0) | steps.isNull(), f"hole {name} expects a path").when(bad, f"path {name} has a step that is no token")
    return F.when(text.isNull(), f"hole {name} expects a token").when(~text.rlike(TOKEN), f"prose in hole {name}")


def frame_reason(v: Column) -> Column:
    """A frame's payload has ``frame``, the name of a frame in the book, and ``slots``, just its holes."""
    return bind(string_at(v, "$.frame"), lambda name: bind(F.try_variant_get(v, "$.slots", "variant"), lambda slots: _frame_reason(v, name, slots)))


def _frame_reason(v: Column, name: Column, slots: Column) -> Column:
    reason = F.coalesce(_unknown(v, ("frame", "slots"), "frame"), F.when(name.isNull(), "frame is missing frame").when(~kind_at(v, "$.slots").eqNullSafe("map"), "frame is missing slots"))
    reason = F.coalesce(reason, F.when(~name.isin(*[f[0] for f in FRAME_BOOK]), F.concat(F.lit("unknown frame "), name)))
    own = F.lit(None).cast("string")
    for frame, _, _, holes in FRAME_BOOK:
        more = F.array_except(keys_at(slots), F.array(*[F.lit(x) for x in holes]).cast("array<string>"))
        one = F.when(F.size(more) > 0, F.concat(F.lit(f"frame {frame} has unknown hole "), F.get(more, 0)))
        for hole, kind in holes.items():
            one = F.coalesce(one, F.when(kind_at(slots, _path(hole)).isNull(), f"frame {frame} missing hole {hole}"), hole_reason(slots, hole, kind))
        own = F.when(name == frame, one).otherwise(own)
    return F.coalesce(reason, own)


def weave_reason(v: Column) -> Column:
    """A weave has rows, each with a slot of its own."""
    rows = items_at(v, "$.rows")
    slots = F.transform(rows, lambda r: string_at(r, "$.slot"))
    return F.coalesce(
        _unknown(v, ("rows", "result-shape"), "weave"),
        F.when(~(F.size(rows) > 0) | rows.isNull(), "weave has no rows"),
        _first(rows, lambda r: _unknown(r, ROW_FIELDS, "weave")),
        F.when(F.exists(slots, lambda s: ~F.coalesce(s.rlike(TOKEN), F.lit(False))), "a weave's slot must be a token"),
        F.when(F.size(F.array_distinct(slots)) < F.size(slots), "a weave's slot is given twice"),
    )


def weave_shape(v: Column) -> Column:
    """What a weave gives: its slots and heads, as JSON."""
    slots = F.transform(items_at(v, "$.rows"), lambda r: F.struct(string_at(r, "$.slot").alias("slot"), string_at(r, "$.head").alias("head")))
    return F.to_json(F.struct(F.lit("WeaveResult").alias("shape"), slots.alias("slots")))


def call_reason(v: Column, fence: str) -> Column:
    """Arguments of a call have a content id, and their text stands between ``<fence-...>`` marks."""

    def argument(a: Column) -> Column:
        fenced = F.coalesce(string_at(a, "$.fenced"), F.lit(""))
        name = F.coalesce(string_at(a, "$.name"), F.lit("?"))
        return F.coalesce(
            _unknown(a, ARGUMENT_FIELDS, "call"),
            F.when(F.coalesce(F.trim(string_at(a, _path("content-id"))), F.lit("")) == "", F.concat(F.lit("argument "), name, F.lit(" has no content id"))),
            F.when(~(F.contains(fenced, F.lit(f"<{fence}-")) & F.contains(fenced, F.lit(f"</{fence}-"))), F.concat(F.lit("argument "), name, F.lit(" must be fenced"))),
        )

    return F.coalesce(
        _unknown(v, ("name", "args", "model-params"), "call"),
        F.when(string_at(v, "$.name").isNull(), "call is missing name").when(items_at(v, "$.args").isNull(), "call is missing args"),
        _first(items_at(v, "$.args"), argument),
    )


def _spec_reason(v: Column, spec: dict[str, str], label: str) -> Column:
    reason = _unknown(v, spec, label)
    for name, kind in spec.items():
        found = kind_at(v, _path(name))
        reason = F.coalesce(reason, F.when(found.isNull(), f"{label} is missing {name}"))
        if kind == "texts":
            texts = F.forall(items_at(v, _path(name)), lambda x: kind_at(x).eqNullSafe("string"))
            reason = F.coalesce(reason, F.when(~F.coalesce(texts, F.lit(False)), f"{name} of {label} is no list of texts"))
        elif kind != "any":
            reason = F.coalesce(reason, F.when(found != kind, f"{name} of {label} is no {kind}"))
    return reason


def collab_reason(kind: str, v: Column) -> Column:
    """What is wrong with a review, vote, patch, evidence, receipt or attestation."""
    reason = _spec_reason(v, COLLAB_FIELDS[kind], kind)
    if kind == "Vote":
        scores = items_at(v, "$.scores")
        reason = F.coalesce(reason, F.when(F.size(scores) == 0, "a vote has no score"), _first(scores, lambda s: _spec_reason(s, SCORE_FIELDS, "Score")))
    return reason


def part_reason(kind: Column, payload: Column, fence: str = "data") -> Column:
    """What is wrong with one part: a kind that is not in the book, or its payload."""
    return bind(parsed(payload), lambda v: _part_reason(kind, v, fence))


def _part_reason(kind: Column, v: Column, fence: str) -> Column:
    checks = {"Frame": frame_reason(v), "Call": call_reason(v, fence), "Weave": weave_reason(v)} | {k: collab_reason(k, v) for k in COLLAB}
    reason = F.when(~F.coalesce(kind.isin(*[p[0] for p in PART_BOOK]), F.lit(False)), F.concat(F.lit("unknown part "), F.coalesce(kind, F.lit("null"))))
    for name, own in checks.items():
        reason = reason.when(kind == name, own)
    return reason


def parent_moves(parents: Column) -> Column:
    """The moves that parents name; null for one that gives no evidence."""
    return F.transform(parents, lambda p: F.nullif(F.regexp_extract(p, r"(?s)#move=(.*)$", 1), F.lit("")))


def move_reason(move: Column, moves: Column, kinds: Column) -> Column:
    """Whether a move is known, may answer its parents, and has the parts it needs."""
    reason = F.when(~F.coalesce(move.isin(*[m[0] for m in MOVES]), F.lit(False)), F.concat(F.lit("unknown move "), F.coalesce(move, F.lit("null"))))
    for name, rule, answers, required, any_of, _ in MOVES:
        legal = {
            "opens": F.size(moves) == 0,
            "only": (F.size(moves) > 0) & (F.size(F.array_except(moves, F.array(*[F.lit(a) for a in answers]).cast("array<string>"))) == 0),
            "any-non-receipt": (F.size(moves) > 0) & ~F.array_contains(moves, "receipt"),
            "any": F.size(moves) > 0,
        }[rule]
        own = F.when(~legal, f"{name} may not answer its parents").when(~F.array_contains(kinds, required), f"{name} requires a {required} part")
        if any_of:
            own = own.when(~F.arrays_overlap(kinds, F.array(*[F.lit(x) for x in any_of])), f"{name} requires {' or '.join(any_of)}")
        reason = reason.when(move == name, own)
    return reason


def content_id(text: Column) -> Column:
    """Algorithm and digest of a canonical text."""
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def packet_text(packets: DataFrame) -> Column:
    """A packet's canonical text: its fields but for id and warrant, as JSON with sorted parents."""
    return F.to_json(F.struct("move", F.array_sort("parents").alias("parents"), "body"))


def spec_id(kind: Column) -> Column:
    """The content id of a part's entry in the book; null for unknown kinds."""
    found = F.lit(None).cast("string")
    for name, shown, authority in PART_BOOK:
        found = F.when(kind == name, f'{{"part":"{name}","shown":"{shown}","authority":"{authority}"}}').otherwise(found)
    return F.when(found.isNotNull(), content_id(found))


def warrant_of(body: Column) -> Column:
    """The kinds of parts that a packet uses, in order of their names, each with the content id of its entry in the book."""
    kinds = F.array_sort(F.array_distinct(F.transform(body, lambda p: p["kind"])))
    return F.transform(kinds, lambda k: F.struct(k.alias("kind"), spec_id(k).alias("cid")))


def check(packets: DataFrame, verify: bool = False, fence: str = "data") -> DataFrame:
    """``packets`` with the first ``reason`` against each: parts in order, evidence of parents, the move, the profile, and with ``verify`` the warrant."""
    rows = packets.withColumns({"_kinds": F.transform("body", lambda p: p["kind"]), "_moves": parent_moves(F.col("parents"))})
    rows = rows.withColumn("_found", matching_profiles(F.col("_kinds")))
    kinds, moves, found = F.col("_kinds"), F.col("_moves"), F.col("_found")
    reason = F.coalesce(
        _first(F.col("body"), lambda p: part_reason(p["kind"], p["payload"], fence)),
        F.when(F.exists(moves, lambda m: m.isNull()), "a parent gives no evidence of its move"),
        move_reason(F.col("move"), moves, kinds),
        F.when(F.size(found) == 0, "the parts match no profile").when(F.size(found) > 1, F.concat(F.lit("the parts match several profiles: "), F.array_join(found, ", "))),
    )
    if verify:
        own = warrant_of(F.col("body"))
        reason = F.coalesce(reason, F.when(F.col("warrant").isNull(), "a warrant is required").when(~F.col("warrant").eqNullSafe(own), "the warrant does not match the book"))
    return rows.withColumn("reason", reason).drop("_kinds", "_moves", "_found")


def stamp(packets: DataFrame) -> DataFrame:
    """``packets`` with their content id ``cid``."""
    return packets.withColumn("cid", content_id(packet_text(packets)))


def verify_stamp(packets: DataFrame) -> DataFrame:
    """``packets`` with the ``reason`` why their ``cid`` is not that of their content, or null."""
    expected = content_id(packet_text(packets))
    return packets.withColumn("reason", F.when(F.col("cid").isNull(), "no content id to verify").when(F.col("cid") != expected, "content id mismatch"))


def render_frame(payload: Column) -> Column:
    """A frame's sentence: prefix and template with its holes filled; null where the frame is wrong, or where it holds prose."""
    return bind(parsed(payload), lambda v: bind(F.try_variant_get(v, "$.slots", "variant"), lambda slots: F.when(frame_reason(v).isNull(), _rendered(v, slots))))


def _rendered(v: Column, slots: Column) -> Column:
    name = string_at(v, "$.frame")
    out = F.lit(None).cast("string")
    for frame, prefix, template, holes in FRAME_BOOK:
        text = F.lit(prefix + template)
        for hole, kind in holes.items():
            steps = F.array_join(F.transform(items_at(slots, _path(hole)), lambda x: string_at(x, "$")), "/")
            value = {"path": steps, "token": string_at(slots, _path(hole)), "prose": F.lit(None).cast("string")}[kind]
            text = F.replace(text, F.lit(f"{{{hole}}}"), value)
        out = F.when(name == frame, text).otherwise(out)
    return out


def ownership_reason(rendered: Column, spans: Column) -> Column:
    """Whether the texts of ``spans`` tile what was rendered: the first byte that none owns, or bytes after the last."""
    step = lambda at, s: F.when(at < 0, at).when(F.substring(F.encode(rendered, "utf-8"), at + 1, F.octet_length(s)) == F.encode(s, "utf-8"), at + F.octet_length(s)).otherwise(-1 - at)
    at = F.aggregate(spans, F.lit(0), step)
    return F.when(at < 0, F.concat(F.lit("unowned bytes at "), (-1 - at).cast("string"))).when(at < F.octet_length(rendered), "unowned trailing bytes")
