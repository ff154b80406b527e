"""Functions of text and token sequences that SQL lacks, and the columns made of them."""
