"""Operations of a training-data pipeline: tokens, duplicates, licences, quality, privacy, archives."""
