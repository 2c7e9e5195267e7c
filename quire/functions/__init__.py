"""Pure Python over bytes: lexing, parsing, codecs, file formats, writing.  No Spark import; runs in workers."""
