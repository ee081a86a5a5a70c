"""Commit fingerprint: 32 minima of 64-bit linear permutations, in bigint.

Products of two 64-bit numbers overflow bigint and raise under ANSI mode, so
the constant is taken in 16-bit and the commit id in 32-bit pieces; no
intermediate exceeds 2**51.  Expressions are SQL text: 32 of them built from
Column calls take longer than the job.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_SHA_LENGTH = 16


# Multiplier and increment of each permutation.
CONSTANTS = (
    (0x1240A4684403B161, 0xE6597A653A88F56C),
    (0xCEA3878A334B2405, 0x69D159FF840B6434),
    (0x4129E2A8044A57CF, 0x7635FD6023661CD6),
    (0xC3585B60B755FB13, 0xE6E65A16D20F1230),
    (0xC33CEDCE35493FC9, 0x2DFAD8EE5206E23E),
    (0x6152BC863269F1D1, 0x4B4D21185D6BB25E),
    (0xD4C0473FECA7A8DB, 0x3A323D15BA6ED8A1),
    (0x9E287F590D2DCBBF, 0x387BFB70928E621D),
    (0x96E23F7B90AC8163, 0xD14936FBAB23CB64),
    (0xC71C3E57D858543B, 0x15064B65D8C7E8C8),
    (0x6AA2BADA80CED407, 0xB77991CBB7C8CC3E),
    (0xE6B4F544E1E6A0B5, 0x84960A7923FCB2E6),
    (0x68F978FE50ACA8EF, 0x91E0E1F94618C62F),
    (0xB116FB80BA37BE51, 0x8541699F88F59552),
    (0x4A8C8E8D6361D8ED, 0x66D9F09745E6C104),
    (0x9675B6DEC15BF8BD, 0xC7647E466B1BFC69),
    (0x183262A1AE6456F5, 0xE586B93D795FEFED),
    (0x1F749DB43A13A74B, 0xFD40D9B0A4FD3FEF),
    (0x06784F88D03A5D47, 0x4547BFC6F345C658),
    (0x21C9676DFFF9BD23, 0x2DB5ACFA31F0CE37),
    (0x39CA2D8837EF13EF, 0xE2306CA1503096C5),
    (0x906AC941285C6AD5, 0x1CAA897054BCEB4F),
    (0x063EEC8294097367, 0x11358B662D019C3A),
    (0x3C8C2991ED9C36AD, 0x5083700E681E07B0),
    (0xF3AA267C6F755F1B, 0x3E4E5B543F52F832),
    (0x389CB58DEC358B7B, 0x67BDC599E5D2FCE1),
    (0x849A24675B580623, 0xD0A801EF5D327DA9),
    (0xE2E0E65E23EB29E1, 0x16B582BE772B968B),
    (0xA958E9A9C7AFC6E5, 0xD5CC3A5326DBF6BC),
    (0x9EEBCF6AE1503C95, 0x2CB8115DC7BFD1B2),
    (0xB211488E5BE49D87, 0xFFD180BC2B7F226A),
    (0x0AC3DE4A77F7A505, 0x154D124CD8BE7D12),
)
PERMUTATIONS = len(CONSTANTS)


def sha_halves(sha: Column) -> list[Column]:
    """Upper and lower 32 bits of the first 16 hex digits."""
    return [F.conv(F.substring(sha, start, 8), 16, 10).cast("bigint") for start in (1, 9)]


def permuted_key(high: str, low: str, index: int) -> Column:
    """(a * x + b) mod 2**64 of the named half columns, mapped to bigint so
    that order is kept."""
    multiplier, increment = CONSTANTS[index]
    a0, a1, a2, a3 = [(multiplier >> shift) & 0xFFFF for shift in (0, 16, 32, 48)]
    b_high, b_low = increment >> 32, increment & 0xFFFFFFFF
    lower = f"({a0}L * {low} + shiftleft({a1}L * {low} & 65535L, 16) + {b_low}L)"
    upper = (
        f"(shiftright({a1}L * {low}, 16) + shiftright({lower}, 32) + {a2}L * {low}"
        f" + shiftleft({a3}L * {low} & 65535L, 16) + {a0}L * {high}"
        f" + shiftleft({a1}L * {high} & 65535L, 16) + {b_high}L)"
    )
    mask = "4294967295L"
    return F.expr(f"(({upper} & {mask}) - 2147483648L) * 4294967296L + ({lower} & {mask})")


def key_text(key: Column) -> Column:
    """16 hex digits of the unsigned number behind a key."""
    unsigned = key.bitwiseXOR(F.lit(-(2**63)))
    return F.lpad(F.lower(F.hex(unsigned)), 16, "0")
