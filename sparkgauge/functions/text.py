"""Text, JSON and map helpers as column expressions, and the lexical rule tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import once

# The failure modes in order of precedence, and the patterns that hint at them in a lower-case trace.
PRECEDENCE = ("procedural_template", "figure_ground_inversion", "endpoint_misidentification", "analytic_parameterisation", "graph_abstraction", "exploration_leakage", "topology_fabrication", "fabricated_verification", "satisficing", "clearance_failure", "corridor_departure", "near_miss_precision", "wrong_branch")
LEXICAL = {
    "figure_ground_inversion": (
        r"\bwalls?\b[^.]{0,40}\b(are|as)\b[^.]{0,20}\b(paths?|corridors?|routes?|traversable)",
        r"\b(corridors?|paths?)\b[^.]{0,40}\b(are|as)\b[^.]{0,20}\bwalls?\b",
        r"\b(actually|instead)\b[^.]{0,50}\b(traversable|walkable|open)\b",
        r"\binvert(ed|ing)?\b[^.]{0,30}\b(wall|corridor|figure|ground)",
        r"\b(background|bands?|regions?)\b[^.]{0,30}\brepresents?\b[^.]{0,20}\bwalls?\b",
    ),
    "topology_fabrication": (
        r"\b(hidden|secret|implicit)\b[^.]{0,30}\bconnect(ion|ed|s)?\b",
        r"\bteleport",
        r"\b(likely|probably|must be|could be)\b[^.]{0,40}\b(interconnected|connected)\b",
        r"\bassume\b[^.]{0,40}\b(connect|passage|opening|gap)\b",
        r"\bthere (must|should) be\b[^.]{0,30}\b(a )?(gap|opening|passage|corridor)\b",
    ),
    "analytic_parameterisation": (
        r"\bradius\b[^.]{0,30}\b(about|approximately|~|of)\b",
        r"\b(stepping|step) through angles?\b",
        r"\b(polar|angular)\b[^.]{0,20}\b(coordinates?|sweep|steps?)\b",
        r"\bsmooth arc\b",
        r"\barc path\b",
        r"\bcounterclockwise|clockwise\b[^.]{0,40}\b(spiral|ring|around)\b",
        r"\bat angle\b\s*\d",
    ),
    "graph_abstraction": (
        r"\bnodes?\b[^.]{0,30}\b(connected|edges?|graph)\b",
        r"\b[A-J]\s*\((start|goal)\)",
        r"\blet'?s identify (the )?nodes\b",
        r"\bnode\s+[A-J]\b",
        r"\badjacency\b",
    ),
    "exploration_leakage": (
        r"\bdead[- ]end\b[^.]{0,60}\b(avoid|not the correct|wrong)\b",
        r"\bthis is not the correct path\b",
        r"\bbacktrack",
        r"\bgo back to the (start|beginning)\b",
        r"\bfrom the starting point,? (go|head)\b",
    ),
    "fabricated_verification": (
        r"\b(checked|verified|confirmed)\b[^.]{0,30}\b(all|entire|every|whole)\b",
        r"\bverified the (entire|whole|full)\b",
        r"\bno collisions?\b",
        r"\bstays? (well )?(within|inside) the corridor\b",
        r"\bthis path is (valid|clear|safe)\b",
        r"\bi'?m confident in this (path|route)\b",
        r"\bcheck(ed|ing)? its integrity\b",
        r"\bno (blockages?|obstructions?|dead ends?) (on the way|along)\b",
        r"\beach node connects correctly\b",
    ),
    "satisficing": (
        r"\b(can be|is) approximate\b",
        r"\bgood enough\b",
        r"\bmaybe\b[^.]{0,20}\.\s*(fine|ok|okay)\b",
        r"\bfine\.\s",
        r"\bnot (fully |entirely )?sure\b[^.]{0,40}\b(submit|proceed|go with)\b",
        r"\bi'?ll (just )?(commit|go with|trust)\b",
        r"\bapproximate(ly)? (route|path)\b",
    ),
}
PERCEPTUAL = (r"\(\s*\d+\s*,\s*\d+\s*\)", r"\b0\.\d{2,}\b", r"\bx\s*[=~]\s*\d", r"\by\s*[=~]\s*\d", r"\b(cyan|amber|teal|orange)\b", r"\b(top|bottom)[- ](left|right)\b")
#: Without any of these, no pattern of the mode can match: a plain search that spares the patterns.
HINTS = {
    "figure_ground_inversion": ("wall", "actually", "instead", "invert", "represent"),
    "topology_fabrication": ("connect", "teleport", "assume", "there "),
    "analytic_parameterisation": ("radius", "angle", "polar", "angular", "arc", "clockwise"),
    "graph_abstraction": ("node", "(start", "(goal", "adjacency"),
    "exploration_leakage": ("dead", "correct path", "backtrack", "go back", "starting point"),
    "fabricated_verification": ("check", "verif", "confirm", "collision", "corridor", "this path", "confident", "integrity", "blockage", "obstruction", "each node", "dead end"),
    "satisficing": ("approximat", "enough", "maybe", "fine", "sure", "commit", "go with", "trust"),
}
#: Input and output token counts under the names that vendors give them, first match wins.
USAGE_IN, USAGE_OUT = ("input_tokens", "prompt_tokens", "prompt_token_count"), ("output_tokens", "completion_tokens", "candidates_token_count")


def _match(text: Column, patterns: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | F.regexp_like(text, F.lit("(?U)" + p))
    return found


def _any(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def lexical_hits(trace: Column) -> Column:
    """Modes that a trace hints at, in the table's order; an empty array for null."""
    hits = lambda low: F.array_compact(F.array(*[F.when(_any(low, HINTS[m]) & _match(low, ps), F.lit(m)) for m, ps in LEXICAL.items()]))
    return once(F.lower(F.coalesce(trace, F.lit(""))), hits)


def quotes(trace: Column, mode: str, around: int = 40) -> Column:
    """For each pattern of a mode, its first match with some text on either side, line ends as spaces, trimmed."""
    low, out = F.lower(trace), []
    for p in LEXICAL[mode]:
        at, hit = F.regexp_instr(low, F.lit("(?U)" + p)), F.regexp_substr(low, F.lit("(?U)" + p))
        start = F.greatest(F.lit(1), at - around)
        out.append(F.when(at > 0, F.trim(F.translate(F.substring(trace, start, at - start + F.length(hit) + around), "\n", " "))))
    return F.array_compact(F.array(*out))


def perceptual(trace: Column) -> Column:
    """Whether a trace names anything it could only have seen."""
    return F.coalesce(once(F.lower(trace), lambda low: _match(low, PERCEPTUAL)), F.lit(False))


def classify(trace: Column, hits: Column, g: dict[str, Column], started: Column, free: Column, progress: Column) -> Column:
    """Modes whose evidence holds, in order of precedence: the first is primary. g holds the path's measures."""
    said = lambda m: F.array_contains(hits, m)
    wrong_start, collided = F.coalesce(~started, F.lit(False)), F.coalesce(~free, F.lit(False))
    first, outside = F.coalesce(g["first_outside"], F.lit(1.0)), g["outside_fraction"]
    legal = outside < 0.02
    when = {
        "procedural_template": trace.isNotNull() & ~perceptual(trace) & (F.size(hits) == 0) & (F.length(trace) < 1200),
        "figure_ground_inversion": (outside > 0.45) & (first < 0.25) & (said("figure_ground_inversion") | ((outside > 0.7) & ~wrong_start)),
        "endpoint_misidentification": wrong_start,
        "analytic_parameterisation": said("analytic_parameterisation") & (g["spacing_cv"] < 0.55) & (g["points"] >= 12),
        "graph_abstraction": said("graph_abstraction") & (g["mean_segment"] > 55),
        "exploration_leakage": said("exploration_leakage") & ((g["reversals"] >= 1) | (g["revisit"] > 0.12)),
        "topology_fabrication": said("topology_fabrication") & (progress > 0.25),
        "fabricated_verification": said("fabricated_verification"),
        "satisficing": said("satisficing"),
        "clearance_failure": legal & collided,
        "corridor_departure": ~legal & collided,
        "near_miss_precision": (progress > 0.6) & (outside < 0.08) & (g["start_error"] <= g["start_radius"]),
        "wrong_branch": legal & ~collided,
    }
    return F.array_compact(F.array(*[F.when(when[m], F.lit(m)) for m in PRECEDENCE]))


def first_nonblank(*columns: Column) -> Column:
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in columns])


def usage(payload: Column, names: tuple[str, ...]) -> Column:
    """The first numeric value among names in a JSON object, cut to a whole number; 0 without any."""
    return F.coalesce(*[F.get_json_object(payload, f"$.{n}").try_cast("double").cast("bigint") for n in names], F.lit(0).cast("bigint"))


def redact(m: Column) -> Column:
    """A map without entries whose key names a key."""
    return F.map_filter(m, lambda k, v: ~F.contains(F.lower(k), F.lit("key")))


def scrub(text: Column, prefixes: dict[str, str]) -> Column:
    """Each replacement starts from the original, so the last prefix that occurs decides."""
    out = text
    for old, new in prefixes.items():
        out = F.when(F.contains(text, F.lit(old)), F.replace(text, F.lit(old), F.lit(new))).otherwise(out)
    return out


def backoff(attempt: Column, base: float, cap: float, u: Column) -> Column:
    """Full-jitter exponential backoff: u times the smaller of cap and base 2^attempt."""
    return F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2.0), attempt)) * u


def submission_error(points: Column, low: int = 2, high: int = 512) -> Column:
    """Why a submission (VARIANT) is rejected, or null: the first failing check, naming the first bad point."""
    kind = F.schema_of_variant(points)
    raw = F.try_variant_get(points, "$.points", "variant")
    items = F.try_variant_get(points, "$.points", "array<variant>")
    n = F.size(items)

    def bad(item: Column, i: Column) -> Column:
        at = F.concat(F.lit("point "), i.cast("string"))
        out = F.lit(None).cast("string")
        for key in ("y", "x"):
            value = F.try_variant_get(item, f"$.{key}", "variant")
            number = F.try_variant_get(item, f"$.{key}", "double")
            typed = F.schema_of_variant(value)
            out = (
                F.when(value.isNull(), F.concat(at, F.lit(f" is missing '{key}'")))
                .when(~(typed.isin("BIGINT", "DOUBLE") | typed.startswith("DECIMAL")), F.concat(at, F.lit(f" '{key}' is not a number")))
                .when((number < 0) | (number > 1), F.concat(at, F.lit(f" '{key}' is outside [0, 1]")))
                .otherwise(out)
            )
        return F.when(~F.schema_of_variant(item).startswith("OBJECT"), F.concat(at, F.lit(" is not an object"))).otherwise(out)

    errors = F.filter(F.transform(items, bad), lambda e: e.isNotNull())
    return (
        F.when(kind.isNull() | ~kind.startswith("OBJECT"), "arguments must be an object")
        .when(raw.isNull(), "missing required 'points' array")
        .when(~F.schema_of_variant(raw).startswith("ARRAY"), "'points' must be an array")
        .when(n < low, F.concat(F.lit("too few points ("), n.cast("string"), F.lit(f" < {low})")))
        .when(n > high, F.concat(F.lit("too many points ("), n.cast("string"), F.lit(f" > {high})")))
        .otherwise(F.get(errors, F.lit(0)))
    )


def coordinate_clause(width: Column | None = None, height: Column | None = None) -> Column:
    """What a prompt says of coordinates; the clause on the image's size only where both sides are known. The wording is a fixed value."""
    text = F.lit("Coordinates are normalized to the image: (0,0) is the top-left corner, (1,1) is the bottom-right corner.")
    if width is None or height is None:
        return text
    size = F.format_string("The image is %d pixels wide and %d pixels tall, so a pixel position (px, py) normalizes to (px/%d, py/%d).", width, height, width, height)
    return F.concat_ws(" ", text, F.when(width.isNotNull() & height.isNotNull(), size))


def spread_labels(ys: Column, gap: float = 2.6) -> Column:
    """Places of labels, in ascending order, moved up so that each is at least gap above the one before."""
    place = lambda out, y: F.concat(out, F.array(F.when(F.size(out) > 0, F.greatest(y, F.element_at(out, -1) + gap)).otherwise(y)))
    return F.aggregate(F.array_sort(ys), F.array().cast("array<double>"), place)
