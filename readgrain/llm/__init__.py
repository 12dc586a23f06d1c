"""Operations of a training-data pipeline: mixing, tokens, personal data, copies, languages, fingerprints, quality, licences."""
