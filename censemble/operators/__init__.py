"""DataFrame-to-DataFrame operators: cells, priors, sampling, votes, transcripts, spend."""
