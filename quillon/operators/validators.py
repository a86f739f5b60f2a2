"""Validators of research documents and media: JSON (as variants) held against declared schemas, errors as arrays of messages in a fixed order.

A schema that a document doesn't have the version of, or that lacks or mistypes a field, is reported alone; rules about its items follow only
on a sound document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.text import bound

#: Version, choices, and the documents' fields with their types; required ones first.
VERSION = "1.0.0"
STATUSES = ["verified", "context", "analysis", "conflicted", "rejected", "stale"]
SOURCE_TYPES = ["primary", "authoritative-secondary", "independent-secondary", "community", "analysis"]
TIERS, RISKS, CLAIM_TYPES = ["standard", "deep"], ["low", "medium", "high"], ["fact", "analysis"]
TEXT, LIST, OBJECT, NUMBER = "string", "array", "object", "number"
DISCOVERY = {
    "required": ["schemaVersion", "contentId", "researchRunId", "timeWindow", "locale", "sources", "sourceCount"],
    "fields": {"schemaVersion": TEXT, "contentId": TEXT, "researchRunId": TEXT, "timeWindow": OBJECT, "locale": TEXT, "sources": LIST, "failedSources": LIST, "sourceCount": NUMBER, "runMetadata": OBJECT},
    "choices": {},
}
BRIEF = {
    "required": ["schemaVersion", "contentId", "researchRunId", "researchQuestion", "researchTier", "claimsToVerify", "candidateSources"],
    "fields": {"schemaVersion": TEXT, "contentId": TEXT, "researchRunId": TEXT, "researchQuestion": TEXT, "audience": TEXT, "contentFormat": TEXT, "deadline": TEXT, "researchTier": TEXT, "claimsToVerify": LIST, "candidateSources": LIST, "knownFacts": LIST, "openQuestions": LIST, "userMaterials": LIST},
    "choices": {"researchTier": TIERS},
}
EVIDENCE_PACK = {
    "required": ["schemaVersion", "contentId", "researchRunId", "evidence"],
    "fields": {"schemaVersion": TEXT, "contentId": TEXT, "researchRunId": TEXT, "evidence": LIST, "conflicts": LIST, "runMetadata": OBJECT},
    "choices": {},
}
CLAIM_MAP = {
    "required": ["schemaVersion", "contentId", "researchRunId", "claims"],
    "fields": {"schemaVersion": TEXT, "contentId": TEXT, "researchRunId": TEXT, "claims": LIST, "runMetadata": OBJECT},
    "choices": {},
}
EVIDENCE_ITEM = ["evidenceId", "claimId", "statement", "sourceType", "source", "verification"]
NESTED = {"source": ["url", "title", "publisher", "accessedAt"], "verification": ["status", "confidence"], "usage": []}
CLAIM_ITEM = ["claimId", "type", "text"]
CLAIM_FIELDS = ["claimId", "evidenceId", "type", "text", "articleSection", "riskLevel"]
MEDIA_TYPES, PRESETS, MODES, FITS, FOCUSES = ["image", "video"], ["fade", "ken-burns", "slide", "zoom", "none"], ["background", "fullscreen"], ["cover", "contain"], ["top", "center", "bottom"]


def _first(base: Column, more: Column) -> Column:
    """A document's own errors; where it has none, those of its items."""
    return bound(base, lambda b: F.when(F.size(b) > 0, b).otherwise(more))


def _none() -> Column:
    return F.array().cast("array<string>")


def at(v: Column, name: str) -> Column:
    """A field of an object, null where there is none."""
    return F.try_variant_get(v, f"$.{name}", "variant")


def text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def kind(v: Column) -> Column:
    """What JavaScript calls the value's type, arrays and null apart."""
    name = F.regexp_extract(F.schema_of_variant(v), "^([A-Z]+)", 1)
    return F.when(name == "ARRAY", LIST).when(name == "OBJECT", OBJECT).when(name == "STRING", TEXT).when(name == "BOOLEAN", "boolean").when(name == "VOID", "null").otherwise(NUMBER)


def have(v: Column) -> Column:
    """Neither missing nor null."""
    return v.isNotNull() & ~F.coalesce(F.is_variant_null(v), F.lit(True))


def truthy(v: Column) -> Column:
    """Present, and neither '', 0 nor false."""
    return have(v) & F.when(kind(v).isin(LIST, OBJECT), True).otherwise(~F.coalesce(text(v), F.lit("")).isin("", "0", "false"))


def filled(v: Column) -> Column:
    """A text that isn't empty."""
    return F.coalesce(have(v) & (kind(v) == TEXT) & (text(v) != ""), F.lit(False))


def messages(*checks: tuple[Column, Column | str]) -> Column:
    """The messages of the checks that hold."""
    made = [F.when(F.coalesce(c, F.lit(False)), F.lit(m) if isinstance(m, str) else m) for c, m in checks]
    return F.array_compact(F.array(*made)) if made else _none()


def say(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("undefined")) for p in parts])


def _mistyped(v: Column, want: str, field: str) -> tuple[Column, Column]:
    return have(v) & (kind(v) != want), say(f'Field "{field}" must be of type {want}, got ', kind(v))


def object_errors(doc: Column, schema: dict) -> Column:
    """Version, required fields, types and choices of a whole document."""
    missing = [(~have(at(doc, f)), f"Missing required field: {f}") for f in schema["required"]]
    typed = []
    for f, want in schema["fields"].items():
        v = at(doc, f)
        typed.append(_mistyped(v, want, f))
        if f in schema["choices"]:
            some = schema["choices"][f]
            typed.append((have(v) & ~text(v).isin(*some), say(f'Field "{f}" must be one of [{", ".join(some)}], got "', text(v), '"')))
    version = text(at(doc, "schemaVersion"))
    plain = F.coalesce(kind(doc) == OBJECT, F.lit(False))
    return (
        F.when(~plain, F.array(F.lit("Input must be a plain object")))
        .when(~version.eqNullSafe(VERSION), F.array(say('schemaVersion "', version, f'" does not match expected "{VERSION}"')))
        .otherwise(messages(*missing, *typed))
    )


def each_item(doc: Column, name: str, rules: Callable[[Column, Column], Column]) -> Column:
    """Messages of rules(item, prefix) over a field's items, none if it isn't an array."""
    items = F.try_variant_get(doc, f"$.{name}", "array<variant>")
    return F.coalesce(F.flatten(F.transform(items, lambda x, i: rules(x, F.concat(F.lit(f"{name}["), i.cast("string"), F.lit("]"))))), _none())


def _loose(x: Column) -> Column:
    """An object, or an array, which counts as one here."""
    return F.coalesce(have(x) & kind(x).isin(OBJECT, LIST), F.lit(False))


def _strict(x: Column) -> Column:
    return F.coalesce(have(x) & (kind(x) == OBJECT), F.lit(False))


def _or_plain(sound: Column, p: Column, found: Column) -> Column:
    return F.when(sound, found).otherwise(F.array(F.concat(p, F.lit(" must be a plain object"))))


def discovery_errors(doc: Column) -> Column:
    """Of a pool of candidate sources: each has an address or a title, failed ones a name and a reason, and their number is right."""
    return bound(doc, _discovery_errors)


def _discovery_errors(doc: Column) -> Column:
    base = object_errors(doc, DISCOVERY)
    sources = each_item(doc, "sources", lambda x, p: _or_plain(_loose(x), p, messages((~truthy(at(x, "url")) & ~truthy(at(x, "title")), say(p, " must have at least a url or title")))))
    failed = each_item(doc, "failedSources", lambda x, p: _or_plain(_loose(x), p, messages(*[(~filled(at(x, f)), say(p, f".{f} must be a non-empty string")) for f in ("name", "reason")])))
    n, own = F.try_variant_get(doc, "$.sourceCount", "double"), F.size(F.try_variant_get(doc, "$.sources", "array<variant>"))
    count = messages((n != own, say("sourceCount (", text(at(doc, "sourceCount")), ") does not match sources.length (", own.cast("string"), ")")))
    return _first(base, F.concat(sources, failed, count))


def brief_errors(doc: Column) -> Column:
    """Of a research brief: its claims have ids, questions and known risks."""
    return bound(doc, _brief_errors)


def _brief_errors(doc: Column) -> Column:
    base = object_errors(doc, BRIEF)

    def claim(x: Column, p: Column) -> Column:
        risk = at(x, "riskLevel")
        wrong = truthy(risk) & ~text(risk).isin(*RISKS)
        return _or_plain(_loose(x), p, messages((~filled(at(x, "claimId")), say(p, ".claimId must be a non-empty string")), (~filled(at(x, "question")), say(p, ".question must be a non-empty string")), (wrong, say(p, f".riskLevel must be one of [{', '.join(RISKS)}], got \"", text(risk), '"'))))

    return _first(base, each_item(doc, "claimsToVerify", claim))


def evidence_errors(doc: Column) -> Column:
    """Of an evidence pack: items have their fields, nested ones theirs, and known kinds and states. What isn't an object is told twice, by either pass."""
    return bound(doc, _evidence_errors)


def _evidence_errors(doc: Column) -> Column:
    base = object_errors(doc, EVIDENCE_PACK)

    def item(x: Column, p: Column) -> Column:
        own = messages(*[(~have(at(x, f)), say(p, f" missing required field: {f}")) for f in EVIDENCE_ITEM])
        nested = []
        for name, need in NESTED.items():
            v = at(x, name)
            lacks = messages(*[(~have(at(v, f)), say(p, f".{name} missing required field: {f}")) for f in need])
            nested.append(F.when(~have(v), _none()).when(~_strict(v), F.array(say(p, f".{name} must be a plain object"))).otherwise(lacks))
        return _or_plain(_strict(x), p, F.concat(own, *nested))

    def choices(x: Column, p: Column) -> Column:
        check, status, of = at(x, "verification"), at(at(x, "verification"), "status"), at(x, "sourceType")
        wrong = _loose(check) & truthy(status) & ~text(status).isin(*STATUSES)
        return _or_plain(_strict(x), p, messages(
            (wrong, say(p, f".verification.status must be one of [{', '.join(STATUSES)}], got \"", text(status), '"')),
            (truthy(of) & ~text(of).isin(*SOURCE_TYPES), say(p, f".sourceType must be one of [{', '.join(SOURCE_TYPES)}], got \"", text(of), '"')),
        ))

    return _first(base, F.concat(each_item(doc, "evidence", item), each_item(doc, "evidence", choices)))


def claim_map_errors(doc: Column) -> Column:
    """Of an article's claims: their fields are texts and known ones, and a fact names its evidence."""
    return bound(doc, _claim_map_errors)


def _claim_map_errors(doc: Column) -> Column:
    base = object_errors(doc, CLAIM_MAP)

    def item(x: Column, p: Column) -> Column:
        checks = [(~have(at(x, f)), say(p, f" missing required field: {f}")) for f in CLAIM_ITEM]
        for f in CLAIM_FIELDS:
            v = at(x, f)
            checks.append((have(v) & (kind(v) != TEXT), say(p, f".{f} must be of type {TEXT}, got ", kind(v))))
            some = {"type": CLAIM_TYPES, "riskLevel": RISKS}.get(f)
            if some:
                checks.append((have(v) & ~text(v).isin(*some), say(p, f'.{f} must be one of [{", ".join(some)}], got "', text(v), '"')))
        return _or_plain(_strict(x), p, messages(*checks))

    fact = lambda x, p: messages((_loose(x) & (text(at(x, "type")) == "fact") & ~filled(at(x, "evidenceId")), say(p, ".evidenceId must be a non-empty string for fact-type claims")))
    return _first(base, F.concat(each_item(doc, "claims", item), each_item(doc, "claims", fact)))


def media_errors(media: Column, exists: Column) -> Column:
    """(valid, errors, warnings) of a scene's media (a struct of type, path, animation, mode, volume, fit, focus); ``exists``: whether its file is there. No media is valid."""
    set_ = lambda f: F.coalesce(media[f], F.lit("")) != ""
    odd = lambda f, some: set_(f) & ~media[f].isin(*some)
    wrong = messages((~F.coalesce(media["type"].isin(*MEDIA_TYPES), F.lit(False)), say('Invalid media type: "', media["type"], '". Must be "image" or "video".')), (~set_("path"), "Media path is required."))
    volume = media["volume"]
    warned = messages(
        (set_("path") & ~exists, say("Media file not found: ", media["path"], ". Scene will fall back to CSS background.")),
        (odd("animation", PRESETS), say('Unknown animation preset: "', media["animation"], '". Will use "fade" instead.')), (odd("mode", MODES), say('Unknown media mode: "', media["mode"], '". Will use "background" instead.')),
        ((media["animation"] == "ken-burns") & (media["type"] == "video"), 'ken-burns animation is not supported for video. Will use "fade" instead.'),
        ((volume < 0) | (volume > 1), say("Volume ", F.regexp_replace(volume.cast("string"), r"\.0$", ""), " is out of range [0, 1]. Will be clamped at render time.")),
        (odd("fit", FITS), say('Unknown fit value: "', media["fit"], '". Will use "cover" instead.')), (odd("focus", FOCUSES), say('Unknown focus value: "', media["focus"], '". Will use "center" instead.')),
    )
    none = media.isNull()
    return F.struct((none | (F.size(wrong) == 0)).alias("valid"), F.when(none, _none()).otherwise(wrong).alias("errors"), F.when(none, _none()).otherwise(warned).alias("warnings"))
