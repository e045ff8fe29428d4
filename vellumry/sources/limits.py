"""Guards of the readers and writers; fixed values."""

BLANK_ROWS = 50          # consecutive blank rows kept in a row gap
COLUMNS = 16384          # spreadsheet columns read
CELL_CHARS = 32767       # characters per written cell, in UTF-16 units
SHEET_NAME = 31          # characters of a sheet name
CELL_SPAN = 64           # table cell span
PAGE_DEPTH = 64          # page tree
REFERENCE_DEPTH = 32     # chains of references
FORM_DEPTH = 12          # nested forms
OPERANDS = 64            # operand stack
SNIFF_BYTES = 1024
HEADER_OFFSET = 4096
FILE_BYTES = 512 * 1024 * 1024
