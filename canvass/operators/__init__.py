"""DataFrame -> DataFrame operators of the questionnaire workflow."""
