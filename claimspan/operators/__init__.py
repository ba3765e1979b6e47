"""DataFrame-to-DataFrame steps that turn raw claims into the wide claims table."""
