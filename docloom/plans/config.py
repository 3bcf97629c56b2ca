"""Retrieval settings by mode and class of question: fixed values of the application that is modelled."""

from __future__ import annotations

# Mode: proposition limit, section limit, final top n, context characters, history pairs.
MODES = {"fast": (20, 20, 6, 10000, 3), "balanced": (30, 30, 8, 14000, 5), "deep": (40, 40, 10, 16000, 6)}
DEFAULT_MODE = "balanced"
# Class: boost multiplier, page range, all books; then by mode: top n and character adjustments.
CLASSES = {
    "spec_lookup": (2.0, 1, False, {"fast": (0, 0), "balanced": (0, 0), "deep": (0, 0)}),
    "process": (1.0, 2, False, {"fast": (0, 0), "balanced": (2, 2000), "deep": (2, 2000)}),
    "comparison": (1.5, 1, True, {"fast": (2, 0), "balanced": (4, 2000), "deep": (4, 2000)}),
    "overview": (1.0, 0, False, {"fast": (-3, -2000), "balanced": (-2, -4000), "deep": (-3, -2000)}),
    "general": (1.0, 1, False, {"fast": (0, 0), "balanced": (0, 0), "deep": (0, 0)}),
}
BOOST_BOTH, BOOST_CHILD, RRF_K, MMR_WEIGHT = 0.12, 0.10, 60, 0.7
ADAPTIVE_THRESHOLD, ADAPTIVE_FACTOR, MIN_PARENTS, SUPPLEMENT = 0.15, 2, 3, 5
# Words of a chunk that is shown whole, and of a segment; characters of a linear table; specifications shown, and their banner.
LONG_WORDS, SEGMENT_WORDS, LEAST_LINEAR, SPECS_SHOWN = 450, 220, 30, 30
SPECS_BANNER = "=== VERIFIED TECHNICAL SPECIFICATIONS (Knowledge Graph) ==="
# Fixed value: what the prompt asks for after each question.
REMINDER = (
    "\n\nIMPORTANT: Your answer must be COMPLETE and SELF-CONTAINED. DO NOT say 'see table', 'refer to table', 'as shown in table', 'see page', or any similar phrase. "
    "If the context contains specification data or table values, EXTRACT and PRESENT all relevant values DIRECTLY in your answer. Never redirect the user to look at a table or page."
)
LEAST_CHARS, PAGE_CAP, PAGE_TRIM, CHUNK_TRIM = 2000, 9000, 500, 200
#: The threshold for the scores of the stand-in, which aren't those of a neural model.
ADAPTIVE_STANDIN = 1.5
#: Questions whose id is divisible by this are asked; reranked candidates below this score are left out (0: none).
EVERY, RERANK_FLOOR = 100, 0.0
#: The same for lookups that few questions answer.
EVERY_LOOKUP = 10
#: So many times the limit of BM25 hits are fused.
HYBRID_POOL = 2
ADJACENT, SEPARATOR = 2, "\n\n---\n\n"


def route_rows() -> list[tuple]:
    """(mode, class, prop_limit, sect_limit, top_n, max_chars, history_pairs, boost, page_range, cross_book)."""
    out = []
    for mode, (props, sects, top, chars, history) in MODES.items():
        for name, (boost, pages, cross, by_mode) in CLASSES.items():
            more, text = by_mode[mode]
            out.append((mode, name, props, sects, max(1, top + more), max(LEAST_CHARS, chars + text), history, boost, pages, cross))
    return out
