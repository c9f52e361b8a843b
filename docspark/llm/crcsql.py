"""The unsigned crc32 of a text as DuckDB SQL, which has no such function."""

#: One row with the table of the reflected polynomial as the column crc_table.
CRC32_TABLE = "SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)), i)) AS crc_table"


def crc32_sql(x: str) -> str:
    """The crc32 of the UTF-8 bytes of the SQL expression x, a step a byte, where crc_table is in scope."""
    octets = f"list_transform(range(octet_length(encode({x}))), lambda i: ('0x' || substr(hex(encode({x})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce({octets}, lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"
