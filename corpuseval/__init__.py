"""DataFrame operators that curate, label and evaluate text corpora."""
