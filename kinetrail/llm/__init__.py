"""Operators for large training-data pipelines, and their registered queries."""

from . import chat, leaks, licenses, lines, mixing, neardup, quality, repeats, resample, search, secrets, simhash, tokens

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_chat": chat.op2_chat,
    "op3_lines": lines.op3_lines,
    "op4_tokens": tokens.op4_tokens,
    "op5_leaks": leaks.op5_leaks,
    "op6_neardup": neardup.op6_neardup,
    "op7_repeats": repeats.op7_repeats,
    "op8_secrets": secrets.op8_secrets,
    "op9_quality": quality.op9_quality,
    "op10_licenses": licenses.op10_licenses,
    "op11_resample": resample.op11_resample,
    "op12_simhash": simhash.op12_simhash,
    "op13_search": search.op13_search,
}
ORACLE_SQL = {
    "op1_mixing": mixing.OP1_SQL,
    "op2_chat": chat.OP2_SQL,
    "op3_lines": lines.OP3_SQL,
    "op5_leaks": leaks.OP5_SQL,
    "op6_neardup": neardup.OP6_SQL,
    "op7_repeats": repeats.OP7_SQL,
    "op8_secrets": secrets.OP8_SQL,
    "op11_resample": resample.OP11_SQL,
    "op12_simhash": simhash.OP12_SQL,
    "op13_search": search.OP13_SQL,
}
