"""The queries of this subpackage, each over whole tables, and their DuckDB SQL where SQL can express them."""

from . import codes, fingerprints, harmonic, language, lexical, mixing, neardup, neighbours, packing, quality, repeats, tokens, urls

QUERIES = {
    "op1_token_counts": tokens.op1_token_counts,
    "op2_neighbours": neighbours.op2_neighbours,
    "op3_quality": quality.op3_quality,
    "op4_near_duplicates": neardup.op4_near_duplicates,
    "op5_urls": urls.op5_urls,
    "op6_packing": packing.op6_packing,
    "op7_language": language.op7_language,
    "op8_substring_dedup": repeats.op8_substring_dedup,
    "op9_fingerprints": fingerprints.op9_fingerprints,
    "op10_mixing": mixing.op10_mixing,
    "op11_vector_codes": codes.op11_vector_codes,
    "op12_harmonic_packing": harmonic.op12_harmonic_packing,
    "op13_lexical_search": lexical.op13_lexical_search,
}

#: The others have a model, a tokenizer or an approximation in them; tests hold these against plain forms.
ORACLES: dict[str, str] = {"op4_near_duplicates": neardup.SQL, "op8_substring_dedup": repeats.SQL, "op10_mixing": mixing.SQL, "op11_vector_codes": codes.SQL, "op13_lexical_search": lexical.SQL}
