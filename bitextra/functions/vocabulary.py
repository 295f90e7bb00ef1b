"""Word data of the glued-word scan and the pattern built from it."""

from __future__ import annotations

# Frequent function words.
FUNCTION_WORDS = tuple(
    """
a about above after again against all also always an and any are as at
be because been before being below between both but by
can cannot could
did do does down during
each either else
few for from
get give go good
had has have having he her here hers herself him himself his how
i if in into is it its itself
just
like
many may me might more most much must my myself
neither no nor not now
of off on once one only or other our ours ourselves out over own
same say shall she should so some someplace something somewhere still such
than that the their theirs them themselves then there these they this those
through thus to too
under until up upon us
very
we well what when where which while who whom why will with within without
would
you your yours yourself yourselves
""".split()
)

# Subject words of the surveyed domain (a parameter of the scan).
SUBJECT_WORDS = tuple(
    """
project projects engineering topographic topography survey surveys surveying
investigation investigations production capacity construction building
create created creating update updated up-to-date plan plans plant plants
design designing designed works work field land data soil area water ground
site report reports results conclusion introduction section
layers formation facilities object objects territory scale marks networks
purpose final initial stage stages performed methods according
basis based including includes included provided requires required
development develop developed possible use used using conduct conducting
carried carry processing complex paraffin oils refinery owner customer
contractor documents documentation technical information conditions
compliance natural environmental protection safety industrial sanitary
requirements existing planned reconstructed roads highways railways
pipeline pipelines wells boreholes indicators determinations current state
strips route routes width longitudinal transverse profiles geodetic
horizontal cartographic materials maps digital terrain model
models relief sections height reference network benchmarks points
photogrammetric aerial geodesic satellite global positioning systems
precision accuracy errors permissible coordinate coordinates elevations
engineering-geological geological hydrogeological physical
mechanical properties engineering-geodynamic processes karst subsidence
""".split()
)

# Real words a splitter would take apart.
COMPOUNDS = tuple(
    """
another anybody anyhow anymore anyone anything anyway
anywhere because everybody everyone everything everywhere
footnote footnotes groundwater henceforth herself himself
however indoor indoors input into itself meanwhile
moreover myself nobody nonetheless northeast northwest
notwithstanding oneself online onto otherwise outdoor
outdoors outside output southeast southwest sometime
sometimes somewhat somewhere themselves thereafter
thereby therefore therein thereof thereto underneath
unless upstairs upstream whereas whereby wherein
whatever whenever wherever workshop workbook workplace
workpiece worldwide yourself yourselves
abovementioned aboveground underground
together throughout
""".split()
)


def _branch(words: list[str]) -> str:
    """Alternation over words that share a consumed prefix, longest match first."""
    heads: dict[str, list[str]] = {}
    for w in words:
        if w:
            heads.setdefault(w[0], []).append(w[1:])
    arms = [h.replace("-", r"\-") + _branch(rest) for h, rest in sorted(heads.items())]
    if not arms:
        return ""
    body = arms[0] if len(arms) == 1 and "" not in words else f"(?:{'|'.join(arms)})"
    return body + ("?" if "" in words else "")


def piece_pattern(words) -> str:
    """Pattern that takes the longest listed word (two letters or more) at a position.

    Prefixes are shared, so one position costs at most the length of the
    longest word however large the vocabulary is.
    """
    return _branch(sorted({w for w in words if len(w) >= 2}))


def word_pattern(words) -> str:
    """Pattern that matches exactly the listed words; one step per letter."""
    return f"^(?:{_branch(sorted(set(words)))})$"
